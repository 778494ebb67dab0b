"""Near copies of texts: candidates by least hashes of their shingles, then an exact check.

The companion of `simhash.py` for a limit on the Jaccard similarity of shingle sets. A SimHash of any radius that can be probed
misses pairs whose edits lie in one block, so candidates come from keys of least hashes here, which do not depend on where
texts differ; SimHash components themselves are `simhash.near_duplicates`.

1. A text has BANDS keys, each of a few least hashes, and a sketch: two bits of every least hash. Only texts with an equal key
   are ever compared, bucket by bucket, and first by their sketches, which leave out a pair at the limit once in a thousand
   million times and nearly all pairs far below it.
2. Of the pairs left, those that span each bucket (most alike first) are checked on the texts themselves; what passes is joined.
3. A pair that fails must hide no other. Where pairs of step 2 failed, all texts that they span meet once more, slice by slice, and
   those not joined yet are compared exactly by the shingles they share. Only texts alike by their sketches get there: texts
   of one template far below the limit do not.

A text travels once for each pair of step 2, of which there are fewer than texts, and in step 3 once for each slice of its group.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.components import components
from tallyforge.llm.shared import discard, partitions, stored, text_key
from tallyforge.llm.simhash import SLICE, _cells, _forest, _spanning, shingles

#: Shingles of the texts of a slice, where texts are compared.
SLICE_SHINGLES = 500_000

#: Keys of a text; two texts are candidates if one key is equal. Of pairs at the similarity asked for, at most MISS have none.
BANDS, MISS = 32, 1e-5
#: Least hashes in a key, at most.
DEPTH = 8


def band_depth(similarity: float) -> int:
    """Least hashes in each key: as many as leave the pairs at that similarity without an equal key a share of MISS or less."""
    return max(r for r in range(1, DEPTH + 1) if r == 1 or (1 - similarity**r) ** BANDS <= MISS)


@lru_cache
def _turns(depth: int) -> tuple[np.ndarray, np.ndarray]:
    turn, factor = np.random.default_rng(20).integers(0, 1 << 32, (2, BANDS * depth), np.uint32)
    return turn, factor | np.uint32(1)


def band_keys(hashes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """BANDS keys of a set of hashes, each of `depth` least hashes of its members, and the set's sketch; nothing for an empty set.

    Two least hashes are equal with the probability of the Jaccard similarity, wherever in the texts the sets differ.
    """
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    turn, factor = _turns(depth)
    members, least = hashes.astype(np.uint32)[:, None], np.full(BANDS * depth, np.iinfo(np.uint32).max, np.uint32)
    turned = np.empty((128, BANDS * depth), np.uint32)
    for at in range(0, len(hashes), len(turned)):
        some = turned[: len(hashes) - at]
        np.bitwise_xor(members[at : at + len(turned)], turn, out=some)
        np.multiply(some, factor, out=some)
        np.minimum(least, some.min(axis=0), out=least)
    mixed = (least + (turn.astype(np.uint64) << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).reshape(BANDS, depth)
    pairs = (least * np.uint32(0x9E3779B1) >> np.uint32(30)).astype(np.uint64).reshape(-1, BANDS)
    return mixed.sum(axis=1, dtype=np.uint64).view(np.int64), (pairs << np.arange(0, 2 * BANDS, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many least hashes the sketches (rows) say are different."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1)


def most_unlike(similarity: float, depth: int) -> int:
    """Different least hashes that sketches of a pair at the similarity show at most, but for six standard deviations."""
    n, p = BANDS * depth, 0.75 * (1 - similarity)
    return int(n * p + 6 * np.sqrt(n * p * (1 - p)))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """64-bit hashes of the different shingles of a text, sorted."""
    import xxhash

    found = set(shingles(text, words))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(42)), np.uint64, len(found)))


def _sketches(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(id, doc_id, tk, bands, sketch) of rows (id, doc_id, tk, text)."""
    depth = band_depth(similarity)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [band_keys(shingle_hashes(text, words), depth) for text in batch["text"]]
            yield pd.DataFrame({
                "id": batch["id"], "doc_id": batch["doc_id"].astype("Int64"), "tk": batch["tk"], "bands": [f[0] for f in found], "sketch": [f[1].tobytes() for f in found]})

    return rows.mapInPandas(sketch, "id bigint, doc_id bigint, tk int, bands array<bigint>, sketch binary")


def bucket_pairs(keys: np.ndarray, sketch: np.ndarray, label: np.ndarray, most: int, spanning: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, row) of equal key (rows sorted by key), unequal label, and sketches with at most `most` differences.

    With `spanning`, as many as join all that such pairs join, the most alike first; else all of them.
    """
    n = len(keys)
    at, step, found, waiting = np.arange(n), 0, [], 0
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else at
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    a, b, apart = (np.empty(0, np.int64) for _ in range(3))
    while len(at):
        step += 1
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
        x = at[label[at] != label[at + step]]
        d = unlike(sketch[x], sketch[x + step])
        x, d = x[d <= most], d[d <= most]
        if len(x):
            found.append((x, x + step, d))
            waiting += len(x)
        if waiting and (not len(at) or waiting > 4 * n + 20_000):
            if not spanning:
                yield tuple(np.concatenate([f[i] for f in found]) for i in (0, 1))
            else:
                a, b, apart = (np.concatenate(parts) for parts in zip((a, b, apart), *found))
                order = np.argsort(apart, kind="stable")
                keep = order[_spanning(a[order], b[order], n)]
                a, b, apart = a[keep], b[keep], apart[keep]
                label = _forest(a, b, n)
                one = np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts)
                at = at[~one[group[at]]]
            found, waiting = [], 0
    if spanning:
        yield a, b


def candidate_pairs(buckets: DataFrame, most: int, spanning: bool) -> DataFrame:
    """Pairs (a, b), a < b, of the rows (key, id, sketch, label) of each bucket, see `bucket_pairs`; large buckets meet slice by slice."""
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE)
    large = sizes.select(F.col("key").alias("large"), F.ceil(F.col("n") / SLICE).alias("slices"))
    met = buckets.join(large, F.col("key") == F.col("large"), "left")
    cells = met.select("key", "id", "sketch", "label", F.explode(_cells(F.xxhash64("id", "key"))).alias("cell"))
    dealt = cells.select(F.xxhash64("key", "cell").alias("key"), "id", "sketch", "label")
    dealt = dealt.repartition(partitions(buckets.sparkSession), "key").sortWithinPartitions("key", "id")

    def pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, sketch = rows["id"].to_numpy(np.int64), np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
        for a, b in bucket_pairs(rows["key"].to_numpy(np.int64), sketch, rows["label"].to_numpy(np.int64), most, spanning):
            yield pd.DataFrame({"a": ids[a], "b": ids[b]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = rows["key"].to_numpy(np.int64)
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield from pairs(rows.iloc[:cut])
            rest = rows.iloc[cut:]
        if rest is not None and len(rest):
            yield from pairs(rest)

    return dealt.mapInPandas(compare, "a bigint, b bigint").distinct()


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids of `sets` (id, shingles) whose Jaccard similarity is reached; sets are never empty."""
    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(map(_set, x), map(_set, y)):
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both >= similarity * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("one"))
    other = sets.select(F.col("id").alias("b"), F.col("shingles").alias("other"))
    return pairs.join(one, "a").join(other, "b").where(alike("one", "other")).select("a", "b")


def similar_rows(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between rows of different label whose sets have that Jaccard similarity, as many as join all that such pairs join.

    Shared members are counted by going through the rows that have each member of a row; members of one row only count nowhere.
    """
    n = len(sets)
    sizes, label, links = np.array([len(s) for s in sets], np.int64), np.unique(label, return_inverse=True)[1], []
    if n < 2 or not sizes.any():
        return links
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    kept = count[value] > 1
    row, value = row[kept], value[kept]
    by_value = np.argsort(value, kind="stable")
    having, first = row[by_value], np.concatenate([[0], np.cumsum(np.bincount(value, minlength=len(count)))])
    own = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    left = len(np.unique(label))
    for i in range(n):
        if left == 1:
            break
        mine = value[own[i] : own[i + 1]]
        lengths = first[mine + 1] - first[mine]
        if not len(mine):
            continue
        ends = np.cumsum(lengths)
        at = np.repeat(first[mine] - (ends - lengths), lengths) + np.arange(ends[-1])
        both = np.bincount(having[at], minlength=n)
        hits = np.flatnonzero((both >= similarity * (sizes[i] + sizes - both)) & (both > 0) & (label != label[i]))
        for j in hits[hits > i].tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
                left -= 1
    return links


def open_links(first: DataFrame, links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between texts that pairs of `first` span and `links` leave apart, as many as join all near copies among them."""
    spanned = components(first).select("node", F.col("root").alias("group"))
    joined = components(links).select(F.col("node").alias("_node"), "root")
    labelled = spanned.join(joined, F.col("node") == F.col("_node"), "left").select("node", "group", F.coalesce("root", "node").alias("label"))
    labelled = labelled.join(sets.select("id", (F.octet_length("shingles") / 8).alias("n")), F.col("node") == F.col("id"))
    slices = F.ceil(F.greatest(F.sum("n") / SLICE_SHINGLES, F.count(F.lit(1)) / SLICE))
    sizes = labelled.groupBy(F.col("group").alias("_group")).agg(F.min("label").alias("low"), F.max("label").alias("high"), slices.alias("slices")).where("low < high")
    met = labelled.join(sizes.select("_group", F.when(F.col("slices") > 1, F.col("slices")).alias("slices")), F.col("group") == F.col("_group"))
    placed = met.select(F.col("node").alias("_id"), "label", "group", F.explode(_cells(F.xxhash64("node", "group"))).alias("cell"))
    dealt = sets.join(placed, F.col("id") == F.col("_id")).select(F.xxhash64("group", "cell").alias("key"), "id", "label", "shingles")
    dealt = dealt.repartition(partitions(sets.sparkSession), "key").sortWithinPartitions("key", "id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ids, labels, own = None, [], [], []

        def found() -> list[tuple[int, int]]:
            return [(ids[a], ids[b]) for a, b in similar_rows(own, np.array(labels), similarity)]

        for batch in batches:
            out = []
            for key, i, label, raw in zip(batch["key"], batch["id"], batch["label"], batch["shingles"]):
                if key != last:
                    out += found() if own else []
                    last, ids, labels, own = key, [], [], []
                ids.append(i)
                labels.append(label)
                own.append(_set(raw))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(found() if own else [], columns=["a", "b"], dtype="int64")

    return dealt.mapInPandas(compare, "a bigint, b bigint")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, id, sketch) of the keys that at least two of the nodes (id, bands, sketch) have."""
    keys = nodes.select(F.explode("bands").alias("key"), "id")
    shared = keys.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keys.join(shared, F.col("key") == F.col("_key"), "left_semi")
    return met.join(nodes.select(F.col("id").alias("_id"), "sketch"), F.col("id") == F.col("_id")).select("key", "id", "sketch")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(id, shingles): the sorted 64-bit hashes of each text's different shingles."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "shingles": [shingle_hashes(t, words).tobytes() for t in batch["text"]]})

    return texts.select("id", "text").mapInPandas(cut, "id bigint, shingles binary")


def similar_links(nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) between near copies among `texts` (id, text), as many as join all that near copies join; nodes: (id, bands, sketch)."""
    most = most_unlike(similarity, band_depth(similarity))
    buckets = stored(shared_keys(nodes), "buckets")
    first = stored(candidate_pairs(buckets.withColumn("label", F.col("id")), most, spanning=True), "first-pairs")
    discard(buckets)
    ids = first.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    held = texts.join(ids, F.col("id") == F.col("_id"), "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    sets = stored(shingle_sets(held, words), "shingle-sets")
    links = stored(checked(first, sets, similarity), "first-links")
    out = stored(links.unionByName(open_links(first, links, sets, similarity)), "similar")
    discard(first, sets, links)
    return out


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tk, component, keep): groups of equal texts and of near copies; one row of each group has keep true.

    Near copies have shingle sets of the given Jaccard similarity or more; groups are what chains of them join. The row kept is that
    of the least doc_id (null ids last). Null texts are empty and, like texts without a word, only copies of equal
    ones. `tk` is a hash of the text; rows with equal doc_id and text are one here.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.xxhash64(content).alias("id"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("tk", text_key())
    sketches = stored(_sketches(rows, words, similarity), "sketches")
    nodes = stored(sketches.select("id", "bands", "sketch").dropDuplicates(["id"]).where(F.size("bands") > 0), "nodes")
    links = similar_links(nodes, rows.select("id", "text"), words, similarity)
    roots = components(links).select(F.col("node").alias("_node"), "root")
    discard(nodes, links)
    distinct = sketches.groupBy("id", "doc_id", "tk").agg(F.lit(1).alias("_one"))
    members = distinct.join(roots, F.col("id") == F.col("_node"), "left").select("doc_id", "tk", F.coalesce("root", "id").alias("component"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tk")
    least = members.groupBy(F.col("component").alias("_c")).agg(F.min(rank).alias("_least"))
    joined = members.join(least, F.col("component") == F.col("_c"))
    return joined.select("doc_id", "tk", "component", (F.col("doc_id").eqNullSafe(F.col("_least.doc_id")) & (F.col("tk") == F.col("_least.tk"))).alias("keep"))
