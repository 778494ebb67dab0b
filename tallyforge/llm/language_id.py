"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. For each place of the codewords a binary classifier over hashed byte n-grams tells
the languages with +1 from those with -1 (log-odds of their mean n-gram frequencies). A text's language is the codeword of
least loss, each place weighted by how well its classifier does on that language; if two are nearly as close, it is ambiguous.
Training counts n-grams over all rows, in tasks, and only sums per language and bucket leave them.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import lean

#: N-grams are counted in this many buckets.
BUCKETS = 1 << 14
#: A lead over the second language below this, in weighted loss, is ambiguous.
LEAD = 0.01
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x places, +1 or -1
    weights: np.ndarray  # BUCKETS x places
    scale: np.ndarray  # usual size of each classifier's margin
    trust: np.ndarray  # languages x places, each row sums to 1


def codewords(n: int) -> np.ndarray:
    """All ways to split up to 7 languages in two; beyond, of 100 random codes of 10 log2(n) places that of the largest least distance."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 7:
        places = np.arange(1, 1 << (n - 1))
        return np.vstack([np.ones(len(places)), *(np.where(places >> i & 1, -1.0, 1.0) for i in range(n - 1))])

    def least(code: np.ndarray) -> float:
        apart = (code.shape[1] - code @ code.T) / 2
        return apart[~np.eye(n, dtype=bool)].min()

    draws = (np.random.default_rng(seed).choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n))))) for seed in range(100))
    return max((d[:, np.abs(d.sum(0)) < n] for d in draws), key=least)


def _buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1-, 2- and 3-grams of the texts' bytes, and where each text's begin (texts follow each other)."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    n = len(data)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    out = np.full((n, 3), BUCKETS, np.int64)
    hashed = np.zeros(n, np.uint32)
    for k in range(3):
        m = n - k
        if m <= 0:
            break
        hashed = (hashed[:m] + data[k:] + np.uint32(k + 1)) * np.uint32(2654435761)
        inside = text[:m] == text[k:]
        out[:m, k][inside] = (hashed >> np.uint32(18))[inside]
    return out.ravel(), np.concatenate([[0], ends])[:-1] * 3 if len(texts) else ends


def _counts(texts: list[bytes]) -> np.ndarray:
    """Texts x BUCKETS."""
    buckets, starts = _buckets(texts)
    stops = np.append(starts[1:], len(buckets))
    return np.stack([np.bincount(buckets[a:b], minlength=BUCKETS + 1)[:BUCKETS] for a, b in zip(starts, stops)])


def _groups(texts: list[bytes], most: int = 1 << 18, rows: int = 64) -> Iterator[tuple[int, int]]:
    """Ranges of at most `rows` texts and, unless one text is longer, `most` bytes."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and (size + len(t) > most or i - begin >= rows):
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _encoded(texts: pd.Series) -> list[bytes]:
    return [(t or "").lower().encode() for t in texts]


def _margins(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Mean log-odds per n-gram of each text and place."""
    out = np.zeros((len(texts), weights.shape[1]))
    for a, b in _groups(texts):
        counts = _counts(texts[a:b]).astype(np.float32)
        out[a:b] = (counts @ weights) / np.maximum(counts.sum(1, keepdims=True), 1)
    return out


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learns from all rows with a text and a language; the model's size depends on the number of languages only."""
    known = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, part in batch.groupby("lang", sort=False):
                texts = _encoded(part["text"])
                for a, b in _groups(texts):
                    found = np.bincount(_buckets(texts[a:b])[0], minlength=BUCKETS + 1)[:BUCKETS]
                    total[name] = total.get(name, 0) + found
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": name, "bucket": at.astype(np.int32), "n": n[at]})

    counted = known.mapInPandas(lean(count), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    codes = codewords(len(languages))
    share = np.zeros((len(languages), BUCKETS))
    share[counted["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), counted["bucket"].to_numpy(int)] = counted["n"].to_numpy()
    share = (share + 0.5) / (share + 0.5).sum(1, keepdims=True)
    places = codes.shape[1]
    weights = np.zeros((BUCKETS, places), np.float32)
    for j in range(places):
        weights[:, j] = np.log(share[codes[:, j] > 0].mean(0)) - np.log(share[codes[:, j] < 0].mean(0))
    if not places:
        return Model(languages, codes, weights, np.ones(0), np.ones((len(languages), 0)))
    place_of = {x: i for i, x in enumerate(languages)}
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right, size, n = np.zeros(codes.shape), np.zeros(codes.shape), np.zeros(len(languages))
        for batch in batches:
            row = batch["lang"].map(place_of).to_numpy(int)
            margins = _margins(_encoded(batch["text"]), sent.value)
            np.add.at(right, row, (margins * codes[row] > 0).astype(float))
            np.add.at(size, row, np.abs(margins))
            np.add.at(n, row, 1)
        cells = [(i, j, n[i], right[i, j], size[i, j]) for i in range(len(languages)) for j in range(places) if n[i]]
        yield pd.DataFrame(cells, columns=["language", "place", "n", "correct", "size"])

    judged = known.mapInPandas(lean(judge), "language int, place int, n double, correct double, size double")
    cells = judged.groupBy("language", "place").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"), F.sum("size").alias("size")).toPandas()
    at = cells["language"].to_numpy(int), cells["place"].to_numpy(int)
    trust, size = np.zeros(codes.shape), np.zeros(codes.shape)
    trust[at] = (cells["correct"] + 1) / (cells["n"] + 2)
    size[at] = cells["size"] / cells["n"]
    return Model(languages, codes, weights, np.maximum(size.mean(0), 1e-9), trust / trust.sum(1, keepdims=True))


def losses(margins: np.ndarray, model: Model) -> np.ndarray:
    """Rows x languages: loss-weighted distance of margins to each codeword. Margins of no size are log(2) from all."""
    agreement = model.codes[None] * (margins / model.scale)[:, None, :]
    return (model.trust[None] * np.logaddexp(0, -2 * agreement)).sum(2)


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language, score from 0 to 1, lead in loss over the second) of each row of margins; ties go to the first language."""
    loss = losses(margins, model)
    best = loss.argmin(1)
    rows = np.arange(len(loss))
    chance = np.exp(-(loss - loss.min(1, keepdims=True)) * max(1, model.codes.shape[1]))
    others = np.where(np.arange(loss.shape[1])[None] == best[:, None], np.inf, loss)
    lead = others.min(1) - loss[rows, best]
    return best, chance[rows, best] / chance.sum(1), lead


def predicted(model: Model, text: Column | str = "text", lead: float = LEAD) -> Column:
    """struct(lang_pred, score, ambiguous, loss) of a text; loss is that of the nearest codeword (null for `und`). Texts that are null or have no letter are `und`, as is all if nothing was learned."""
    text = F.col(text) if isinstance(text, str) else text
    nothing = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"), F.lit(None).cast("double").alias("loss"))
    if not model.languages:
        return nothing
    names = np.array(model.languages, object)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean, loss double")
    @lean
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            margins = _margins(_encoded(part), model.weights)
            best, score, apart = decode(margins, model)
            yield pd.DataFrame({"lang_pred": names[best], "score": np.clip(score, 0, 1), "ambiguous": apart < lead, "loss": losses(margins, model).min(1)})

    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), predict(text)).otherwise(nothing)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fourth of the documents that nothing is learned from; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row; learns from the rows not held out that have an id."""
    model = train(docs.where(~held_out(doc_id) & F.col(doc_id).isNotNull()), text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), predicted(model, text).alias("_p"))
    return rows.select("doc_id", "held_out", "_p.lang_pred", "_p.score", "_p.ambiguous")
