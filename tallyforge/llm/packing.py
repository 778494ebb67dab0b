"""Packing of token sequences by minimum bin slack.

Documents are cut into pieces of at most `context` tokens. What a plan needs of them is only how many pieces have each
length, a table of at most `context` numbers however large the corpus is. For that table each step finds, by a bitset
subset-sum over the lengths still there, the fullest sequence that holds the longest one left, and removes it as often as
the counts allow. Each step uses up at least one length, so there are at most `context` steps. Pieces then take their
places by their number among the pieces of equal length.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import lean, partitions, stored
from tallyforge.llm.tokens import token_cache

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


def cut_points(n: int, context: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of `context` tokens but the first, which takes the rest."""
    first = n % context or min(n, context)
    return [(0, first)] + [(at, context) for at in range(first, n, context)] if n else []


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int | None, context: int = 1024, doc_id: str = "doc_id", text: str = "text", remembered: int = 800_000) -> DataFrame:
    """Pieces of at most `context` ids (little-endian unsigned 32-bit) of every text, each document closed by `end_id`.

    Null texts count as empty; a text without any id has no piece. Other columns are left out; ids may repeat or be null. A worker
    remembers the ids of at most `remembered` words; the result does not depend on it.
    """
    def cut(batches: Iterator) -> Iterator[pd.DataFrame]:
        cache = token_cache(vocabulary, remembered)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for part in (batch.iloc[at : at + 256] for batch in batches for at in range(0, len(batch), 256)):
            out: list[tuple] = []
            for key, ids in zip(part["id"], cache.ids(part["text"].tolist())):
                raw = ids.astype("<u4").tobytes() + end
                out += [(key, i, at, n, raw[4 * at : 4 * (at + n)]) for i, (at, n) in enumerate(cut_points(len(raw) // 4, context))]
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInPandas(lean(cut, keeps=True), PIECES)


def slack_plan(counts: dict[int, int], context: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(length, how many), ...]), ...]: the sequences, fullest first around the longest length left.

    Among equally full sequences the one with the longest pieces is taken.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= context for n in left):
        raise ValueError("lengths must be from 1 to the context")
    plan = []
    while left:
        longest = max(left)
        room = context - longest
        mask = (1 << (room + 1)) - 1
        lengths = sorted((n for n in left if n <= room), reverse=True)
        reach, stages = 1, []
        for n in lengths:
            stages.append(reach)
            many = min(left[n] - (n == longest), room // n)
            step = 1
            while many > 0:  # doubling steps reach every number up to `many`
                take = min(step, many)
                reach |= (reach << (take * n)) & mask
                many -= take
                step *= 2
            if reach >> room & 1:
                break
        fill, used = reach.bit_length() - 1, {longest: 1}
        for n, before in zip(reversed(lengths[: len(stages)]), reversed(stages)):
            take = 0
            while not before >> fill & 1:
                fill -= n
                take += 1
            if take:
                used[n] = used.get(n, 0) + take
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
        plan.append((times, sorted(used.items(), reverse=True)))
    return plan


def numbered(pieces: DataFrame, group: str, name: str) -> DataFrame:
    """Adds each row's number (from 0) within its group. Slices by a hash of all columns share the work of a large group."""
    cols = pieces.columns
    n = max(8, partitions(pieces.sparkSession))
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int"))
    sizes = sliced.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(group, "_slice", (F.sum("_n").over(_window(group, "_slice")) - F.col("_n")).alias("_before"))
    ranked = sliced.withColumn("_r", F.row_number().over(_within(group, "_slice", cols)))
    return ranked.join(before, [group, "_slice"]).select(*cols, (F.col("_before") + F.col("_r") - 1).alias(name))


def _window(group: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _within(group: str, part: str, cols: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(group, part).orderBy(*[c for c in cols if c != group])


def pack(pieces: DataFrame, context: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a `length`; no sequence is longer than `context`.

    `pieces` is read twice, so pass a stored table. Rows without a length, or of length 0, get null for both; a length over
    `context` is an error. Repeated rows are packed as often as they stand there.
    """
    fits = pieces.where(F.col("length") > 0)
    counts = {int(r[0]): r[1] for r in fits.groupBy("length").count().limit(context + 1).collect()}
    plan = slack_plan(counts, context)
    lengths: dict[int, list[tuple[int, int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first_sequence = 0
    for times, used in plan:
        at = 0
        for n, k in used:
            lengths.setdefault(n, []).append((taken.get(n, 0), k, first_sequence, at, times))
            taken[n] = taken.get(n, 0) + times * k
            at += n * k
        first_sequence += times
    table = {n: np.array(rows, np.int64) for n, rows in lengths.items()}

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lengths, ranks in batches:
            length, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine, plan_n = length == n, table[int(n)]
                row = plan_n[np.searchsorted(plan_n[:, 0], rank[mine], side="right") - 1]
                inside = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 2] + inside // row[:, 1]
                offset[mine] = row[:, 3] + inside % row[:, 1] * n
            yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

    # only lengths and numbers go to Python; ids stay where they are
    placed = numbered(fits, "length", "_rank").withColumn("_place", place("length", "_rank"))
    placed = placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")
    rest = pieces.where(F.coalesce(F.col("length") <= 0, F.lit(True)))
    return placed.unionByName(rest.withColumns({"sequence_id": F.lit(None).cast("bigint"), "offset": F.lit(None).cast("bigint")}))


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids joined by offset, and its length. A sequence gathers at most `context` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.where(F.col("sequence_id").isNotNull()).groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.reduce(parts, F.lit(b""), lambda got, x: F.concat(got, x["ids"])).alias("ids"),
    )


def packed_digests(docs: DataFrame, vocabulary: str, end_id: int, context: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = token_pieces(docs, vocabulary, end_id, context)
    narrow = stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(narrow, context)


