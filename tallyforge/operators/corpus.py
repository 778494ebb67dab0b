"""From samples and documents to token streams and packed training contexts."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tallyforge import constants as C
from tallyforge.functions.text import _col, count_at_or_below, replace_numbers
from tallyforge.operators.prefix import quantile_slices, ranked, ranked_by_hash, running_totals

MAX_VOCABULARY = 65_535


# ---- samples and tokens ----

def format_sample(prompt: Column | str, answer: Column | str) -> Column:
    """bos + prompt + eoq + answer + eos."""
    return F.concat(F.lit(C.BOS), _col(prompt), F.lit(C.EOQ), _col(answer), F.lit(C.EOS))


def format_samples(df: DataFrame, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    return df.withColumn("text", format_sample(prompt, answer))


def number_vocabulary(spark: SparkSession, kind: str, pieces: list[str] = (), byte_fallback: bool = False) -> DataFrame:
    """Vocabulary table (token, token_id): special tokens, the number tokens of a kind, other pieces, and with `byte_fallback` one
    token for every byte, so that any text can be tokenized whole.

    Kinds: `single` digits, `triple` for 0 to 999, `number` with one number token, `magnitude` with 256.
    """
    numbers = {
        "single": [str(i) for i in range(10)], "triple": [str(i) for i in range(1000)], "number": [C.NUM, C.OVERFLOW],
        "magnitude": [f"<|num_{i}|>" for i in range(256)],
    }[kind]
    tokens = list(dict.fromkeys([*C.SPECIAL_TOKENS, *numbers, *pieces, *(BYTE_TOKENS if byte_fallback else ())]))
    return spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, token_id int")


#: Characters of texts whose tokens go back from Python at once.
TOKENIZED = 1 << 20

#: Tokens of the bytes of characters that no entry covers.
BYTE_TOKENS = [f"<0x{b:02X}>" for b in range(256)]


def _token_schema() -> StructType:
    return StructType([StructField("tokens", ArrayType(IntegerType())), StructField("numbers", ArrayType(DoubleType()))])


def tokenize(df: DataFrame, vocabulary: DataFrame, text: str = "text", numbers: str | None = None, unknown: int | None = None) -> DataFrame:
    """Adds `tokens` and `token_numbers`: the longest vocabulary entry at every position, left to right.

    Characters no entry covers become `unknown`, if given, or the byte tokens of their UTF-8 form; a vocabulary without either is an
    error as soon as it meets such a character. With `numbers` (an array column) the
    number tokens carry these values in order and all other tokens 0. A vocabulary has at most 65 535
    entries (token ids are 16-bit), so it is shipped to every task.
    """
    entries = {r.token: r.token_id for r in vocabulary.limit(MAX_VOCABULARY + 1).collect()}
    if len(entries) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary has at most {MAX_VOCABULARY} entries")
    shipped = df.sparkSession.sparkContext.broadcast(entries)
    numbered = np.array([i for t, i in entries.items() if t == C.NUM or re.fullmatch(r"<\|num_\d+\|>", t)], np.int32)

    @F.pandas_udf(_token_schema())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = dict(shipped.value)
        by_byte = [table.pop(t, None) for t in BYTE_TOKENS]  # their names are no entries of a text

        def uncovered(c: str) -> list[int]:
            if unknown is not None:
                return [unknown]
            if None in by_byte:
                raise ValueError(f"the vocabulary has no entry for {c!r}, no byte tokens and no unknown token")
            return [by_byte[b] for b in c.encode()]

        single = {t for t in table if len(t) == 1}
        # entries by first character, longest first: a regex tries them in that order
        longer = sorted((t for t in table if len(t) > 1), key=len, reverse=True)
        by_first: dict[str, list[str]] = {}
        for t in longer:
            by_first.setdefault(t[0], []).append(re.escape(t[1:]))
        arms = [re.escape(c) + "(?:" + "|".join(rest) + ("|)" if c in single else ")") for c, rest in by_first.items()]
        pattern = re.compile("|".join([*arms, "."]), re.DOTALL)
        for texts, values in batches:
            out_t, out_n, size = [], [], 0
            for s, v in zip(texts, values):
                if size > TOKENIZED:  # a few texts at a time, or all tokens of a batch stand in memory several times
                    yield pd.DataFrame({"tokens": out_t, "numbers": out_n})
                    out_t, out_n, size = [], [], 0
                if s is None:
                    out_t.append(None), out_n.append(None)
                    continue
                ids = np.array([i for m in pattern.findall(s) for i in ((table[m],) if m in table else uncovered(m))], np.int32)
                nums = np.zeros(len(ids))
                if v is not None:
                    at = np.flatnonzero(np.isin(ids, numbered))
                    nums[at[: len(v)]] = v[: len(at)]
                out_t.append(ids), out_n.append(nums)
                size += len(s)
            yield pd.DataFrame({"tokens": out_t, "numbers": out_n})

    values = F.col(numbers) if numbers else F.lit(None).cast("array<double>")
    t = df.withColumn("_tok", run(F.col(text), values))
    return t.withColumn("tokens", F.col("_tok.tokens")).withColumn("token_numbers", F.col("_tok.numbers")).drop("_tok")


def tokenize_numbers(df: DataFrame, vocabulary: DataFrame, text: str = "text", negative: bool = True, magnitude: bool = False) -> DataFrame:
    """Numbers replaced by their tokens first, then tokenized, with the values beside the tokens."""
    t = df.withColumn("_rep", replace_numbers(text, negative, magnitude))
    t = t.withColumn("_text", F.col("_rep.text")).withColumn("_nums", F.col("_rep.numbers")).drop("_rep")
    return tokenize(t, vocabulary, "_text", "_nums").drop("_text", "_nums")


def label_mask(tokens: Column | str, bos: int, eoq: int) -> Column:
    """Labels of a token array: null for the prompt, from a bos up to and including its eoq; else the token."""
    @F.pandas_udf(ArrayType(IntegerType()))
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            out = []
            for t in part:
                if t is None:
                    out.append(None)
                    continue
                t = np.asarray(t)
                prompt = (np.cumsum((t == bos).astype(np.int64) - (t == eoq)) > 0) | (t == eoq)
                out.append([None if hidden else v for v, hidden in zip(t.tolist(), prompt.tolist())])
            yield pd.Series(out)

    return mask(_col(tokens))


def sample_tokens(prompt: Column, answer: Column, bos: int, eoq: int, eos: int) -> tuple[Column, Column]:
    """Token and label arrays of one sample from those of its prompt and answer; no running sums needed."""
    one = lambda v: F.array(F.lit(v))
    tokens = F.concat(one(bos), prompt, one(eoq), answer, one(eos))
    masked = F.array_repeat(F.lit(None).cast("int"), F.size(prompt) + 2)
    return tokens, F.concat(masked, answer, one(eos))


def near_number_mask(df: DataFrame, keys: list[str], pos: str, is_number: str, text: str | None = None, k: int = 20) -> DataFrame:
    """Adds `number_or_sign` and `near_number` (other tokens within k tokens of a number) per context.

    A `-` right before a number belongs to it. Contexts have a fixed length.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    number = F.col(is_number)
    if text:
        number = number | ((F.col(text) == "-") & F.coalesce(F.lead(is_number).over(w), F.lit(False)))
    t = df.withColumn("number_or_sign", number)
    close = F.max(F.col("number_or_sign").cast("int")).over(w.rowsBetween(-k, k)) == 1
    return t.withColumn("near_number", close & ~F.col("number_or_sign"))


# ---- one stream ----

def token_offsets(df: DataFrame, keys: list[str], order: str, length: Column | str = "n_tokens") -> DataFrame:
    """Adds `start`, the first token position of each document in the stream of its source."""
    length = _col(length)
    t = running_totals(quantile_slices(df, order), keys, [order], {"_end": length.cast("bigint")})
    return t.withColumn("start", F.col("_end") - length).drop("_end")


def pack_contexts(df: DataFrame, keys: list[str], arrays: list[str], length: int, offset: int = 0) -> DataFrame:
    """Cuts the stream into contexts of `length` tokens; the short tail is dropped.

    Documents are cut into the slices their contexts need, so a context gathers at most `length` slices.
    `offset` shifts all cuts, as a random start does.
    """
    n = F.size(arrays[0])
    first = F.greatest(F.col("start") - offset, F.lit(0))
    t = df.withColumn("_n", n).filter(F.col("_n") > 0).filter(F.col("start") + F.col("_n") > offset)
    low, high = F.floor(first / length), F.floor((F.col("start") + F.col("_n") - 1 - offset) / length)
    t = t.withColumn("context_idx", F.explode(F.sequence(low, high)))
    begin = F.greatest(F.col("context_idx") * length + offset, F.col("start"))
    stop = F.least((F.col("context_idx") + 1) * length + offset, F.col("start") + F.col("_n"))
    cut = lambda a: F.slice(F.col(a), (begin - F.col("start") + 1).cast("int"), (stop - begin).cast("int"))
    part = F.struct(begin.alias("at"), *[cut(a).alias(a) for a in arrays])
    g = t.select(*keys, "context_idx", part.alias("_part")).groupBy(*keys, "context_idx").agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    g = g.select(*keys, "context_idx", *[F.flatten(F.col(f"_parts.{a}")).alias(a) for a in arrays])
    return g.filter(F.size(arrays[0]) == length)


def position_ids(tokens: Column | str, eos: int) -> Column:
    """Position of every token inside its segment; a new segment starts after each eos."""
    tokens = _col(tokens)
    after = F.filter(F.transform(tokens, lambda t, i: F.when(t == eos, i + 1)), lambda i: i.isNotNull())
    starts, stops = F.concat(F.array(F.lit(0)), after), F.concat(after, F.array(F.size(tokens)))
    none = F.array().cast("array<int>")
    return F.flatten(F.zip_with(starts, stops, lambda a, b: F.when(b > a, F.sequence(F.lit(0), b - a - 1)).otherwise(none)))


def pack_boundaries(positions: Column | str) -> Column:
    """Boundaries of packed sequences: every index with position 0, plus the end; and the longest sequence."""
    positions = _col(positions)
    starts = F.filter(F.transform(positions, lambda p, i: F.when(p == 0, i)), lambda i: i.isNotNull())
    return F.struct(F.array_append(starts, F.size(positions)).alias("cu_seq_lens"), (F.array_max(positions) + 1).alias("max_seq_length"))


def pad_batches(df: DataFrame, batch: str, arrays: dict[str, object], first: str) -> DataFrame:
    """Arrays left-padded to the longest of their batch, with attention mask and position ids.

    Padding positions count 1, as generation expects.
    """
    w = Window.partitionBy(batch)
    t = df.withColumn("_pad", F.max(F.size(first)).over(w) - F.size(first))
    fill = lambda v, a: F.array_repeat(F.lit(v).cast(dict(df.dtypes)[a][6:-1]), F.col("_pad"))
    own = F.size(first)
    out = t.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(0), F.col("_pad")), F.array_repeat(F.lit(1), own)))
    ids = F.when(own > 0, F.sequence(F.lit(0), own - 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("position_ids", F.concat(F.array_repeat(F.lit(1), F.col("_pad")), ids))
    for a, value in arrays.items():
        out = out.withColumn(a, F.concat(fill(value, a), F.col(a)))
    return out.drop("_pad")


# ---- ranges and look-ups ----

def difficulty_ranges(df: DataFrame, keys: list[str], difficulty: str = "difficulty", length: Column | str = "n_tokens") -> DataFrame:
    """Token range of every difficulty when a source is sorted by it: from the first token to the first of the next level."""
    per_level = df.groupBy(*keys, difficulty).agg(F.sum(_col(length)).cast("bigint").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(difficulty).rowsBetween(Window.unboundedPreceding, 0)
    return per_level.withColumn("hi", F.sum("_n").over(w)).withColumn("lo", F.col("hi") - F.col("_n")).select(*keys, difficulty, "lo", "hi")


def global_ranges(ranges: DataFrame, offsets: DataFrame, source: str = "source") -> DataFrame:
    """Ranges moved to global positions by the start of their source."""
    t = ranges.join(offsets.select(source, "source_start"), source)
    return t.withColumn("lo", F.col("lo") + F.col("source_start")).withColumn("hi", F.col("hi") + F.col("source_start")).drop("source_start")


def source_offsets(df: DataFrame, source: str = "source", length: str = "n_tokens", context: int = 0) -> DataFrame:
    """Start of every source in the joined stream; a source counts without its last context."""
    sizes = df.groupBy(source).agg((F.sum(length) - context).cast("bigint").alias("size"))
    w = Window.partitionBy(F.lit(0)).orderBy(source).rowsBetween(Window.unboundedPreceding, 0)
    t = sizes.withColumn("source_end", F.sum("size").over(w))
    return t.select(source, (F.col("source_end") - F.col("size")).alias("source_start"), "source_end")


#: Ranges that a row's look-up halves at once.
RANGES_PER_SLICE = 1024


def lookup_ranges(df: DataFrame, ranges: DataFrame, position: str, value: str, name: str, lo: str = "lo", hi: str | None = "hi", default: int | None = -1) -> DataFrame:
    """As-of look-up: the range with the largest start at or below a position, if the position is not past its end.

    Sorted ranges are cut into slices of RANGES_PER_SLICE. A position finds its slice among the slices' first starts, which
    alone travel whole, and meets the slice's ranges in a join.
    """
    rows = ranges.select(F.col(lo).alias("lo"), (F.col(hi) if hi else F.lit(None).cast("bigint")).alias("hi"), F.col(value).alias("v")).filter("lo IS NOT NULL")
    numbered = ranked(rows, [], "lo", "_rn", ties=["hi", "v"])
    slices = numbered.groupBy(F.floor((F.col("_rn") - 1) / RANGES_PER_SLICE).cast("int").alias("_slice")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "v"))).alias("_in"))
    slices = slices.withColumn("_lo", F.col("_in.lo"))
    firsts = slices.select(F.struct("_slice", F.col("_lo")[0].alias("first")).alias("s")).agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["first"])).scalar()
    t = df.withColumn("_firsts", firsts)
    t = t.withColumn("_at", count_at_or_below(F.col("_firsts"), F.col(position), 1 << 24) - 1).drop("_firsts")
    t = t.join(slices, F.col("_at") == F.col("_slice"), "left")
    hit = F.get("_in", count_at_or_below(F.col("_lo"), F.col(position), RANGES_PER_SLICE) - 1)
    t = t.withColumn("_hit", F.when(F.col("_slice").isNotNull(), hit))
    inside = F.col("_hit.hi").isNull() | (F.col(position) <= F.col("_hit.hi"))
    return t.withColumn(name, F.when(F.col("_hit").isNotNull() & inside, F.col("_hit.v")).otherwise(F.lit(default))).select(*df.columns, name)


# ---- batches by length ----

def length_batches(df: DataFrame, batch: int, keys: list[str], length: Column | str, seed: int = 42) -> DataFrame:
    """Rows of similar length in full batches; batches in hashed order, the short remainder last.

    Adds `batch` (by length) and `batch_order`.
    """
    hashed = F.xxhash64(F.lit(seed), *keys)
    # rows of one length are told apart by their hash, so that a common length is no single slice
    share = hashed.cast("double") / F.lit(2.0**64) + F.lit(0.5)
    t = df.withColumn("_len", _col(length)).withColumn("_at", F.col("_len") + share)
    t = running_totals(quantile_slices(t, "_at"), [], ["_at", *keys], {"_rn": F.lit(1).cast("bigint")})
    t = t.withColumn("batch", F.floor((F.col("_rn") - 1) / batch)).drop("_len", "_at")
    total = df.agg(F.count("*").alias("n")).scalar()
    t = t.withColumn("_full", F.floor(total / batch))
    ids = t.filter(F.col("batch") < F.col("_full")).select("batch").distinct()
    order = ranked_by_hash(ids, [], F.xxhash64(F.lit(seed + 1), "batch"), ["batch"], "batch_order")
    t = t.join(order, "batch", "left")
    return t.withColumn("batch_order", F.coalesce(F.col("batch_order") - 1, F.col("_full"))).drop("_rn", "_full")


# ---- token accounting ----

def count_tokens(text: Column | str, digits: str = "single") -> Column:
    """Tokens of a text when special tokens, groups of digits (single or up to three) and every other character are one token each."""
    group = {"single": "[0-9]", "triple": "[1-9][0-9]{0,2}|0"}[digits]
    return F.length(F.regexp_replace(_col(text), rf"<\|[a-z_0-9]+\|>|{group}", "x"))


def token_accounting(df: DataFrame, dataset: str, prompt: str, output: str, digits: str = "single") -> DataFrame:
    """Input and output tokens per dataset and their means; a prompt costs two more, an empty one two, an empty output none."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    t = df.select(
        dataset, F.when(empty(prompt), 2).otherwise(count_tokens(prompt, digits) + 2).alias("_i"), F.when(empty(output), 0).otherwise(count_tokens(output, digits)).alias("_o"),
    )
    g = t.groupBy(dataset).agg(F.sum("_i").alias("input_tokens"), F.sum("_o").alias("output_tokens"), F.count("*").alias("num_samples"))
    mean = lambda c: F.bround(c / F.col("num_samples"), 1)
    i, o = F.col("input_tokens"), F.col("output_tokens")
    return g.withColumn("mean_input", mean(i)).withColumn("mean_output", mean(o)).withColumn("mean_total", mean(i + o))


def accounting_summary(per_dataset: DataFrame) -> DataFrame:
    """Totals over datasets, means per dataset, and means of the means per sample."""
    return per_dataset.agg(
        F.count("*").alias("datasets"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("num_samples").alias("num_samples"), F.avg("input_tokens").alias("input_per_dataset"), F.avg("output_tokens").alias("output_per_dataset"),
        F.avg("mean_input").alias("mean_input"), F.avg("mean_output").alias("mean_output"), F.avg("mean_total").alias("mean_total"),
    )
