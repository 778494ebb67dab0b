"""URL filters: allow and block rules, and beyond them naive Bayes over segmented hosts and path words.

Hosts run words together. Each run of letters of a host is split by a unigram Viterbi pass: the split of greatest probability
under word counts of all page texts. The words a run could be made of are found by a join of its parts with the counts, so no
dictionary is sent anywhere. A multinomial naive Bayes model then scores host and path words; it learns from all pages with a
word, those with a seed word or blocked by a rule as examples of what to block, over a fixed number of hashed features.
Smoothing is over the features seen, by kind of page, so a few pages are enough to tell.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import stored

#: Longest word a run of letters may be split into.
LONGEST = 24
#: Letters of a run whose words are looked up together.
PIECE = 1024
#: Added to the count of every feature that was seen in either kind of page.
SMOOTHING = 0.1
#: Features of the model; words share them by hash.
FEATURES = 1 << 16
#: Parts a host with very many pages, or a word of very many hosts, is dealt out to in joins.
SALT = 16

# Words that mark sites to block in the training rows.
BLOCK_SEEDS = (
    "casino poker bet bets betting gamble gambling jackpot slots adult porn sex xxx escort nude "
    "pills viagra cialis pharmacy spam ads adserver malware phishing warez crack torrent"
).split()


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains if the url's path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """Rule of a string like `example.com/en/`; the host ends before the first slash."""
    host, slash, rest = text.partition("/")
    return Rule(verdict, host, slash + rest)


def host_and_path(url: Column | str) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty for null or without `://`."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), capitals, capitals.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, null if none does; of equally long ones the one with the longer host."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found, verdict = F.when(fits, r.text).otherwise(found), F.when(fits, r.verdict).otherwise(verdict)
    return found, verdict


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) over all page texts, words of up to LONGEST letters."""
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "<[^>]*>", " ")
    words = pages.select(F.explode(_words(text)).alias("word")).where(F.length("word") <= LONGEST)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class Splitter:
    """Viterbi pass over one run of letters, which may come piece by piece: the most probable words under counts of words.

    A word without a count gets 10 / (total * 10 ** length). Of equally probable splits, the last word is the shortest.
    """

    def __init__(self, run: str, total: int):
        self.run, self.unknown = run, log(10 / max(total, 1))
        self.best, self.back = np.full(len(run) + 1, -np.inf), np.zeros(len(run) + 1, np.int64)
        self.best[0] = 0.0
        self.total = total

    def read(self, begin: int, end: int, known: dict[tuple[int, int], int]) -> None:
        """Goes on from the places begin to end; known: count by (start, length) of words that start there."""
        for start in range(begin, end):
            for size in range(1, min(LONGEST, len(self.run) - start) + 1):
                n = known.get((start, size))
                p = self.best[start] + (log(n / self.total) if n else self.unknown - size * log(10))
                if p >= self.best[start + size]:
                    self.best[start + size], self.back[start + size] = p, start

    def words(self) -> list[str]:
        out, end = [], len(self.run)
        while end:
            out.append(self.run[self.back[end] : end])
            end = int(self.back[end])
        return out[::-1]


def best_split(run: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """Most probable words of a run of letters."""
    whole = Splitter(run, total)
    whole.read(0, len(run), known)
    return whole.words()


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of distinct runs of letters. The words that start in PIECE letters of a run travel together, however long it is."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("run") - F.col("start")))
    keyed = runs.withColumn("key", F.xxhash64("run"))
    # the run itself goes with its first piece only
    pieces = keyed.select("run", "key", F.explode(F.sequence(F.lit(0), F.floor((F.length("run") - 1) / PIECE))).alias("piece"))
    pieces = pieces.select("key", "piece", F.when(F.col("piece") == 0, F.col("run")).alias("whole"), F.substr("run", F.col("piece") * PIECE + 1, F.lit(PIECE + LONGEST)).alias("run"))
    parts = pieces.select("key", "piece", "run", F.explode(F.sequence(F.lit(0), F.least(F.lit(PIECE), F.length("run")) - 1)).alias("start"))
    parts = parts.select("key", "piece", "run", "start", F.explode(sizes).alias("size"))
    parts = parts.select("key", "piece", "start", "size", F.expr("substring(run, start + 1, size)").alias("word"))
    met = parts.join(counts, "word").groupBy("key", "piece").agg(F.collect_list(F.struct("start", "size", "n")).alias("known"))
    rows = pieces.select("key", "piece", "whole").join(met, ["key", "piece"], "left")
    rows = rows.repartition("key").sortWithinPartitions("key", "piece")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Splitter | None = None
        for batch in batches:
            out = []
            for piece, whole, known in zip(batch["piece"], batch["whole"], batch["known"]):
                if piece == 0:
                    if now is not None:
                        out.append((now.run, now.words()))
                    now = Splitter(whole, total)
                begin = piece * PIECE
                found = {} if known is None else {(begin + k["start"], k["size"]): k["n"] for k in known}
                now.read(begin, min(begin + PIECE, len(now.run)), found)
            yield pd.DataFrame(out, columns=["run", "words"])
        if now is not None:
            yield pd.DataFrame([(now.run, now.words())], columns=["run", "words"])

    return rows.mapInPandas(split, "run string, words array<string>")


def _salted(left: DataFrame, right: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """Join on `key` with the left rows of a key dealt out to SALT parts; `right` has one row per key."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
    copies = right.select("*", F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("_salt"))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, host_words) of distinct hosts: the words of its runs of letters, in order."""
    runs = hosts.select("host", F.posexplode(F.array_remove(F.split("host", r"[^\p{L}]+"), "")).alias("place", "run"))
    words = segmented(runs.select("run").distinct(), counts)
    joined = _salted(runs, words, "run", F.col("host")).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "words"))).alias("parts"))
    return joined.select("host", F.flatten(F.transform("parts", lambda p: p["words"])).alias("host_words"))


def features(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int"))


def train(rows: DataFrame, words: str = "words", blocked: str = "blocked") -> tuple[float, np.ndarray]:
    """(prior log-odds, log-odds of each feature) for blocking, from all rows; without examples of both kinds nothing is blocked."""
    kinds = {r[0]: r[1] for r in rows.groupBy(blocked).count().collect()}
    if not (kinds.get(True) and kinds.get(False)):
        return -np.inf, np.zeros(FEATURES)
    seen = rows.select(F.col(blocked).alias("b"), F.explode(features(F.col(words))).alias("f")).groupBy("b", "f").count().toPandas()
    counts = np.zeros((2, FEATURES))
    counts[seen["b"].to_numpy(int), seen["f"].to_numpy(int)] = seen["count"].to_numpy()
    known = counts.sum(0) > 0
    share = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * known.sum())
    return log(kinds[True] / kinds[False]), np.where(known, np.log(share[1]) - np.log(share[0]), 0.0)


def score(model: tuple[float, np.ndarray], words: Column) -> Column:
    """Log-odds that a page with these words is to be blocked."""
    prior, weights = model

    @F.pandas_udf("double")
    def odds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in parts:
            yield pd.Series([prior + weights[np.asarray(f, np.int64)].sum() if len(f) else prior for f in rows], dtype=float)

    return odds(features(words))


def filtered(pages: DataFrame, rules: Sequence[Rule], seeds: Sequence[str] = tuple(BLOCK_SEEDS), page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block: the rule's, else the model's), words and score of every page.

    Null urls and those without `://` have empty host and path and no words; pages without words are allowed. Rows that repeat stay; ids are
    only carried along.
    """
    host, path = host_and_path(url)
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = host_words(rows.select("host").distinct(), word_counts(pages, html))
    joined = _salted(rows, hosts, "host", F.struct("page_id", "path"), "left")
    words = F.concat(F.coalesce("host_words", F.array().cast("array<string>")), _words(F.col("path")))
    joined = stored(joined.select("page_id", "host", "path", words.alias("words")), "url-words")
    found, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seeded = F.arrays_overlap("words", F.array(*[F.lit(s) for s in seeds])) if seeds else F.lit(False)
    model = train(joined.where(F.size("words") > 0).select("words", (F.coalesce(verdict == "block", F.lit(False)) | seeded).alias("blocked")))
    scored = joined.select("page_id", "host", "path", found.alias("rule"), verdict.alias("_verdict"), "words", score(model, F.col("words")).alias("score"))
    verdict = F.coalesce("_verdict", F.when((F.col("score") > 0) & (F.size("words") > 0), "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "words", "score")
