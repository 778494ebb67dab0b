"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into parts of bits that go together. If part i may differ in at most t_i bits and the sum of
(t_i + 1) over the parts is radius + 1, two fingerprints within the radius agree in at least one part up to its own t_i. So
the thresholds need not be equal: a dynamic programme picks those with the fewest candidates, from counts of all
fingerprints. Fingerprints then meet by part value, each value probed with up to t_i bits turned over, and every pair that
meets is verified on all 64 bits. Buckets are compared inside tasks, which return only the links that hold a component
together; a bucket too large for a task is compared slice by slice.
"""
from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence
from itertools import combinations, repeat
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.components import components
from tallyforge.llm.shared import discard, lean, partitions, stored, text_key

#: Rows of a bucket that one task compares at once.
SLICE = 4096
#: Relative costs in the choice of parts: moving a probe, and comparing a pair.
PROBE_COST, PAIR_COST = 200.0, 1.0


def shingles(text: str | None, words: int) -> list[bytes]:
    """Shingles of `words` words, repeats included; all words if there are fewer. Only A-Z are lower-cased."""
    found = (text or "").encode().lower().split()  # bytes are split at \x20 and \x09-\x0D, and no other character
    if not found:
        return []
    if len(found) <= words:
        return [b" ".join(found)]
    return list(map(b" ".join, zip(*(found[i:] for i in range(words)))))


def simhash(parts: Collection[bytes]) -> int:
    """Signed 64-bit SimHash: a bit is set if it is set in over half the hashes of the parts."""
    import xxhash

    hashed = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts))
    bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > len(hashed), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of the shingles of a text; texts without a word have 0."""
    return simhash(shingles(text, words))


def fingerprints(docs: DataFrame, words: int = 4, doc_id: str = "doc_id", text: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, fp) of every row, with `keyed` also `tk`, a hash of its text; null texts count as empty, and rows are never merged."""
    key = ["tk"] * keyed

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = [fingerprint(t, words) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": np.array(fp, np.int64), **{c: batch[c] for c in key}})

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("tk", text_key()) if keyed else rows
    return rows.mapInPandas(lean(hashed), "doc_id bigint, fp bigint" + ", tk int" * keyed)


def _bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits how many have both set: 4096 sums over all rows."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            raw = np.ascontiguousarray(batch["fp"].to_numpy(np.int64))
            bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + (bits.T @ bits), n + len(raw)
        yield pd.DataFrame({"cell": np.arange(4097), "n": np.append(total.ravel(), n).astype(np.int64)})

    got = fps.mapInPandas(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas().sort_values("cell")
    n = got["n"].to_numpy(float)
    return (int(n[-1]), n[:-1].reshape(64, 64)) if len(n) else (0, np.zeros((64, 64)))


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size, each grown by the bit most correlated with those it has."""
    share = both / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    with np.errstate(divide="ignore", invalid="ignore"):
        linked = np.where(spread > 0, np.abs(share - np.outer(p, p)) / spread, 0.0)
    np.fill_diagonal(linked, 0)
    free, groups = list(range(64)), []
    for i in range(parts):
        group = [free.pop(int(np.argmax(linked[np.ix_(free, free)].sum(1))))]
        while len(group) < 64 // parts + (i < 64 % parts):
            group.append(free.pop(int(np.argmax(linked[np.ix_(free, group)].sum(1)))))
        groups.append(sorted(group))
    return groups


def best_thresholds(costs: list[dict[int, float]], radius: int) -> tuple[float, list[int]]:
    """Least total cost, and the threshold of each part, with the sum of (threshold + 1) equal to radius + 1; -1: not probed."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t, c in cost.items():
                if used + t + 1 <= radius + 1 and (used + t + 1 not in now or total + c < now[used + t + 1][0]):
                    now[used + t + 1] = (total + c, [*chosen, t])
        best = now
    return best[radius + 1]


def _costs(n: int, distances: np.ndarray, width: int, radius: int) -> dict[int, float]:
    """Cost of a part by its threshold. distances: share of pairs whose values differ in 0, 1, 2 ... bits."""
    probes = np.cumsum([comb(width, t) for t in range(radius + 1)])
    near = np.cumsum(np.pad(distances, (0, radius + 1))[: radius + 1])
    return {-1: 0.0} | {t: n * PROBE_COST * probes[t] + n * n * near[t] * PAIR_COST for t in range(min(radius, width) + 1)}


def _value(bits: list[int]) -> Column:
    """The part's bits of `fp`, moved together."""
    out = F.lit(0).cast("bigint")
    for place, bit in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", bit).bitwiseAND(F.lit(1).cast("bigint")), place))
    return out


def _pair_distances(counts: np.ndarray) -> np.ndarray:
    """Share of ordered pairs by the number of differing bits, from the count of every value (a Walsh-Hadamard transform)."""
    width = int(np.log2(len(counts)))
    t = counts.astype(float)
    for _ in range(2):
        for i in range(width):
            t = t.reshape(-1, 2, 1 << i)
            t = np.stack([t[:, 0] + t[:, 1], t[:, 0] - t[:, 1]], axis=1).ravel()
        t = t * t if _ == 0 else t / len(counts)
    bits = np.bitwise_count(np.arange(len(counts)))
    return np.bincount(bits, weights=t, minlength=width + 1) / max(counts.sum(), 1) ** 2


def plan_parts(fps: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] for distinct fingerprints `fps`, from statistics of all of them."""
    n, both = _bit_counts(fps)
    n = max(n, 1)  # so that probes cost something in an empty table
    p = np.diag(both) / n
    differ = 2 * p * (1 - p)

    def independent(bits: list[int]) -> np.ndarray:
        out = np.ones(1)
        for b in bits:
            out = np.convolve(out, [1 - differ[b], differ[b]])
        return out

    def estimate(parts: int) -> float:
        groups = grouped_bits(n, both, parts)
        return best_thresholds([_costs(n, independent(g), len(g), radius) for g in groups], radius)[0]

    parts = min(range(2, max(3, min(radius + 1, 16) + 1)), key=estimate)
    groups = grouped_bits(n, both, parts)
    blocks = [(i, g[at : at + 16]) for i, g in enumerate(groups) for at in range(0, len(g), 16)]
    values = F.array(*[F.struct(F.lit(k).alias("block"), _value(g).alias("value")) for k, (_, g) in enumerate(blocks)])
    # at most 65536 values of each of at most 64 / 16 + parts blocks
    seen = fps.select(F.inline(values)).groupBy("block", "value").count().toPandas()
    distances = [np.ones(1) for _ in groups]
    for k, (i, g) in enumerate(blocks):
        mine = seen[seen["block"] == k]
        counts = np.zeros(1 << len(g))
        counts[mine["value"].to_numpy(np.int64)] = mine["count"].to_numpy()
        distances[i] = np.convolve(distances[i], _pair_distances(counts))
    costs = [_costs(n, d, len(g), radius) for d, g in zip(distances, groups)]
    return [(g, t) for g, t in zip(groups, best_thresholds(costs, radius)[1]) if t >= 0]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least reachable row of each of n rows that the links a-b join."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links a-b between n rows to keep so that they join the same rows without a circle; earlier ones first."""
    label, kept, left = np.arange(n), [], np.arange(len(a))
    while len(left):
        left = left[label[a[left]] != label[b[left]]]
        first = np.full(n, len(a))
        for end in (a, b):  # the last of equal places wins, so the earliest link is written last
            first[label[end[left[::-1]]]] = np.minimum(first[label[end[left[::-1]]]], left[::-1])
        pick = np.unique(first[first < len(a)])
        kept.append(pick)
        label = _forest(np.concatenate([a[pick], np.arange(n)]), np.concatenate([b[pick], label]), n)
    return np.concatenate(kept) if kept else left


def bucket_links(keys: np.ndarray, fp: np.ndarray, own: np.ndarray, radius: int, check: np.ndarray | None = None, tiers: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) within `radius` among rows with equal key (sorted by key), as many as join all that any links join.

    Two rows that only came by a probe (own false) need no comparison here. With `check`, a second fingerprint, a link must also
    be within the last tier there; links within an earlier tier are preferred.
    """
    n, bits = len(keys), fp.view(np.uint64)
    second = None if check is None else check.view(np.uint64)
    label, at, step = np.arange(n), np.arange(n), 0  # label: what links of the first tier join so far
    a, b, rank = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    found, waiting = [], 0
    while len(at):
        step += 1
        at = at[at + step < n]
        at = at[keys[at] == keys[at + step]]
        x = at[np.bitwise_count(bits[at] ^ bits[at + step]) <= radius]
        x = x[(own[x] | own[x + step]) & (label[x] != label[x + step])]
        if second is not None:
            tier = np.searchsorted(tiers, np.bitwise_count(second[x] ^ second[x + step]))
            x, tier = x[tier < len(tiers)], tier[tier < len(tiers)]
        else:
            tier = np.zeros(len(x), np.int64)
        if len(x):
            found.append((x, x + step, tier))
            waiting += len(x)
        if waiting > 4 * n + 20_000 or (waiting and not len(at)):
            a, b, rank = (np.concatenate(parts) for parts in zip((a, b, rank), *found))
            order = np.argsort(rank, kind="stable")
            keep = order[_spanning(a[order], b[order], n)]
            a, b, rank = a[keep], b[keep], rank[keep]
            label = _forest(a[rank == 0], b[rank == 0], n)
            found, waiting = [], 0
    return a, b


def _cells(place: Column) -> Column:
    """A large bucket's slices meet two by two: each row goes to as many cells as there are `slices` (null: one cell)."""
    mine = F.pmod(place, F.col("slices"))
    return F.when(F.col("slices").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1), lambda j: F.least(mine, j) * F.col("slices") + F.greatest(mine, j)))


def near_links(nodes: DataFrame, radius: int = 4, tiers: Sequence[int] = ()) -> DataFrame:
    """(a, b): ids of rows of `nodes` (id, fp) whose fingerprints lie within `radius`, as many as join all that such pairs join.

    Not every close pair is returned, so the number of links stays in proportion to the rows even where thousands lie close
    together. With `tiers` the nodes have a second fingerprint `check`, see bucket_links.
    """
    columns = ["id", "fp", *["check"] * bool(tiers)]
    plan = plan_parts(nodes.select("fp"), radius)
    rows = None
    for i, (bits, threshold) in enumerate(plan):
        masks = [sum(1 << b for b in turned) for t in range(threshold + 1) for turned in combinations(range(len(bits)), t)]
        probe = F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])) if len(masks) > 1 else F.lit(0).cast("bigint")
        part = nodes.select(*columns, _value(bits).alias("v"), probe.alias("mask"))
        part = part.where("mask = 0 or v < v ^ mask").select(
            F.xxhash64(F.lit(i), F.col("v").bitwiseXOR(F.col("mask"))).alias("key"), *columns, (F.col("mask") == 0).alias("own"))
        rows = part if rows is None else rows.unionByName(part)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE)
    large = sizes.select(F.col("key").alias("large"), F.ceil(F.col("n") / SLICE).alias("slices"))
    met = rows.join(large, F.col("key") == F.col("large"), "left")
    cells = met.select("key", *columns, "own", F.explode(_cells(F.xxhash64("id", "key"))).alias("cell"))
    dealt = cells.select(F.xxhash64("key", "cell").alias("key"), *columns, "own")
    dealt = dealt.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = rows["key"].to_numpy(np.int64)
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            done, rest = rows.iloc[:cut], rows.iloc[cut:]
            yield link(done)
        if rest is not None:
            yield link(rest)

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        key, ids, fp, own = (rows[c].to_numpy() for c in ("key", "id", "fp", "own"))
        a, b = bucket_links(key, fp, own.astype(bool), radius, rows["check"].to_numpy() if tiers else None, tiers)
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    return dealt.mapInPandas(lean(compare), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hexadecimal digits, and the least id reachable over links.

    Texts without a word share fingerprint 0, which is linked like any other. Rows with the same id are kept as they are; null
    ids do not count as least, and a component of null ids only has a null component_id.
    """
    rows = stored(fingerprints(docs, words, doc_id, text), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(stored(fps.select(F.col("fp").alias("id"), "fp"), "distinct"), radius))
    grouped = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    labelled = grouped.select("fp", "root").join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(labelled, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def least_of_components(docs: DataFrame, words: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tk): of each component of `near_duplicates` the row of least id (null ids last); `tk` is a hash of its text."""
    rows = stored(fingerprints(docs, words, doc_id, text, keyed=True), "fingerprints")
    distinct = stored(rows.select(F.col("fp").alias("id"), "fp").distinct(), "distinct")
    roots = stored(components(near_links(distinct, radius)), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tk")
    least = rows.groupBy("fp").agg(F.min(rank).alias("least")).join(roots, F.col("fp") == F.col("node"), "left")
    kept = least.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least")).select("least.doc_id", "least.tk")
    out = stored(kept, "least-of-components")
    discard(rows, distinct, roots)
    return out
