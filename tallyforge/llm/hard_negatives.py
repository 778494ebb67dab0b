"""Hard negatives of anchors, with score bounds along spanning trees of the anchors.

Scores are inner products of integer vectors. The anchors of one label are cut into groups, and a spanning tree of least total
edge length is laid through each group. A candidate's score at a child differs from that at its parent by at most the edge's
length times the candidate's norm, so a parent's score, or the bounds it has itself, bound the child's. Only candidates whose
bounds overlap what is looked for are scored again: for the positives, all that may reach the best so far; for the negatives, the
windows that the positives' scores open, each cut off at the worst of those it already holds.

Anchors go to the tasks in passes of a fixed size (`PASS`), candidates stay where they are: a pass reads all rows twice, once for
the positives and once for the negatives, and a task returns a few rows for each anchor of the pass. Nothing is dealt out by
label, so a hot label is no hot task. Nothing is left out: bounds only spare products that cannot change the result.

Rows without an id, a label or a vector, or with a null or non-finite component, take no part. A component that a shorter vector lacks counts
as 0. Rows may repeat: each is a candidate (and an anchor) of its own, but a row with the anchor's id is neither a positive nor
a negative of it. Scores must fit a long. Without anchors, positives or negatives in a window there are no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import discard, stored
from tallyforge.operators.prefix import ranked

#: Anchors per pass, and per spanning tree; candidates per block.
PASS, GROUP, BLOCK = 8192, 1024, 2048
#: Float64 holds integers and their sums exactly below this.
EXACT = 2.0**53

FOUND = "anchor bigint, place int, score bigint, id bigint"


def integer_vectors(rows: DataFrame, vec_id: str, label: Column, vector: str, scale: int = 256) -> DataFrame:
    """(id, label, x) of the rows that take part; x = floor(scale * component)."""
    sound = F.coalesce(F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale))
    out = rows.where(sound).select(F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), x.alias("x"))
    return out.where("id is not null and label is not null")


@dataclass(frozen=True)
class Tree:
    """Anchors of one label; every anchor but the first comes after its parent."""

    label: int
    number: np.ndarray  # of the anchor
    ids: np.ndarray
    x: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    norm: float


def matrix(vectors) -> np.ndarray:
    """Rows of integers; shorter ones are filled up with 0. Floats if they are exact, else Python's integers."""
    sizes = {len(v) for v in vectors}
    if len(sizes) == 1:
        out = np.array([np.asarray(v, np.int64) for v in vectors])
    else:
        out = np.zeros((len(vectors), max(sizes, default=0)), np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
    small = not out.size or max(-int(out.min()), int(out.max())) < EXACT
    return out.astype(np.float64) if small else out.astype(object)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)


def products(x: np.ndarray, a: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of the rows of x with a; `bound` is at least their size."""
    d = min(x.shape[1], len(a))
    if bound < EXACT and x.dtype != object and a.dtype != object:
        return (x[:, :d] @ a[:d]).astype(np.int64)
    whole = lambda m: np.array([int(v) for v in m.ravel()], object).reshape(m.shape)
    return whole(x[:, :d]).dot(whole(a[:d])).astype(np.int64)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): the tree of least total length from row 0; parents are places in the order, edges are not below the true lengths."""
    x = x.astype(np.float64)
    n = len(x)
    order, parent, edge = np.zeros(n, int), np.full(n, -1), np.zeros(n)
    far, via, free = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    last = 0
    for i in range(n):
        if i:
            last = int(np.where(free, far, np.inf).argmin())
            parent[i], edge[i] = via[last], far[last]
        order[i], free[last] = last, False
        step = np.sqrt(((x - x[last]) ** 2).sum(1)) * (1 + 1e-12)
        near = free & (step < far)
        far[near], via[near] = step[near], i
    return order, parent, edge


def trees(anchors: pd.DataFrame, group: int = GROUP) -> list[Tree]:
    """Spanning trees through the anchors (number, id, label, x) of each label, at most `group` in one."""
    out = []
    for label, own in anchors.sort_values("number").groupby("label", sort=True):
        for a in range(0, len(own), group):
            part = own.iloc[a : a + group]
            x = matrix(list(part["x"]))
            order, parent, edge = spanning_tree(x)
            out.append(Tree(int(label), part["number"].to_numpy()[order], part["id"].to_numpy()[order], x[order], parent, edge, float(norms(x).max())))
    return out


def bounded_scores(tree: Tree, x: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor (place, rows of x, their scores): all rows at the root, below it those for which wanted(place, low, high) holds."""
    size = norms(x)
    bound = tree.norm * float(size.max(initial=0))
    low, high = np.empty((len(tree.ids), len(x))), np.empty((len(tree.ids), len(x)))
    for c, p in enumerate(tree.parent):
        if p < 0:
            at = np.arange(len(x))
        else:
            reach = tree.edge[c] * size
            low[c], high[c] = low[p] - reach, high[p] + reach
            at = np.flatnonzero(wanted(c, low[c], high[c]))
        score = products(x[at], tree.x[c], bound)
        slack = np.abs(score) * 1e-12
        low[c, at], high[c, at] = score - slack, score + slack
        yield c, at, score


def first(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first by falling score, then by id."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        score, ids = score[score >= edge], ids[score >= edge]
    best = np.lexsort((ids, -score))[:k]
    return score[best], ids[best]


def blocks(batches: Iterator[pd.DataFrame], rows: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of at most `rows` candidates, sorted by label."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            part = batch.iloc[a : a + rows].sort_values("label", kind="stable")
            yield part["id"].to_numpy(), part["label"].to_numpy(), matrix(list(part["x"]))


def positives_of(trees_: list[Tree], k: int):
    """A function for mapInPandas: the k first candidates of the anchor's label that each task has, place 0."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for ids, labels, x in blocks(batches):
            for tree in trees_:
                a, b = np.searchsorted(labels, [tree.label, tree.label + 1])
                if a == b:
                    continue

                def wanted(c: int, low: np.ndarray, high: np.ndarray, tree=tree) -> np.ndarray:
                    held = best.get(tree.number[c], none)[0]
                    return high >= (held[-1] if len(held) == k else -np.inf)

                for c, at, score in bounded_scores(tree, x[a:b], wanted):
                    own = ids[a:b][at]
                    other = own != tree.ids[c]
                    held = best.get(tree.number[c], none)
                    best[tree.number[c]] = first(np.concatenate([held[0], score[other]]), np.concatenate([held[1], own[other]]), k)
        for number, (score, own) in best.items():
            yield pd.DataFrame({"anchor": number, "place": 0, "score": score, "id": own})

    return find


def negatives_of(trees_: list[Tree], windows: dict[int, np.ndarray], k: int):
    """A function for mapInPandas: the k first candidates of other labels in each of the anchor's windows (rows of low, high)."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        open_ = {n: w.astype(np.float64) for n, w in windows.items()}  # the lower end rises as a window fills up
        for ids, labels, x in blocks(batches):
            for tree in trees_:
                others = labels != tree.label
                ids_, x_ = ids[others], x[others]
                if not len(ids_):
                    continue

                def wanted(c: int, low: np.ndarray, high: np.ndarray, tree=tree) -> np.ndarray:
                    hit = np.zeros(len(low), bool)
                    for least, most in open_.get(tree.number[c], ()):
                        hit |= (high >= least) & (low <= most)
                    return hit

                for c, at, score in bounded_scores(tree, x_, wanted):
                    number = tree.number[c]
                    if number not in windows:
                        continue
                    own = ids_[at]
                    inside = (own != tree.ids[c]) & (score >= windows[number][:, 0].min()) & (score <= windows[number][:, 1].max())
                    score, own = score[inside], own[inside]
                    for j, (least, most) in enumerate(windows[number]):
                        fits = (score >= max(least, open_[number][j, 0])) & (score <= most)
                        if fits.any():
                            held = best.get((number, j), none)
                            best[number, j] = got = first(np.concatenate([held[0], score[fits]]), np.concatenate([held[1], own[fits]]), k)
                            if len(got[0]) == k:
                                open_[number][j, 0] = got[0][-1]
        for (number, j), (score, own) in best.items():
            yield pd.DataFrame({"anchor": number, "place": j, "score": score, "id": own})

    return find


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k first of all tasks for each anchor and place, with their rank."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def numbered_anchors(anchors: DataFrame) -> DataFrame:
    """Numbers from 0 that keep labels together and, inside a label, vectors whose leading components have the same signs."""
    signs = F.aggregate(F.transform(F.slice("x", 1, 16), lambda c: (c > 0).cast("bigint")), F.lit(0).cast("bigint"), lambda s, b: s * 2 + b)
    near = anchors.withColumn("_near", F.col("label") * 65536 + signs)
    rows = ranked(near, [], "_near", "_rank", ties=["id", F.xxhash64("x")])
    return rows.select((F.col("_rank") - 1).alias("number"), "id", "label", "x")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, per_pass: int = PASS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (id, label, x) of `integer_vectors`.

    Negatives of a positive have other labels than the anchor and least * positive_score <= 100 * score <= most * positive_score.
    """
    spark = rows.sparkSession
    anchors = stored(numbered_anchors(rows.where(is_anchor)), "anchors")
    total = anchors.agg(F.count(F.lit(1))).first()[0]
    out = None
    for begin in range(0, total, per_pass):
        now = anchors.where(F.col("number").between(begin, begin + per_pass - 1)).toPandas()
        forest = spark.sparkContext.broadcast(trees(now))
        id_of = dict(zip(now["number"], now["id"]))
        near = merged(rows.mapInPandas(lambda b, f=forest: positives_of(f.value, positives)(b), FOUND), positives)
        near = near.orderBy("anchor", "rank").toPandas()
        windows = {
            n: np.array([[-((-least * int(s)) // 100), (most * int(s)) // 100] for s in own["score"]], np.int64) for n, own in near.groupby("anchor", sort=False)}
        sent = spark.sparkContext.broadcast(windows)
        far = rows.mapInPandas(lambda b, f=forest, w=sent: negatives_of(f.value, w.value, negatives)(b), FOUND)
        near["place"] = near["rank"] - 1
        near["anchor_id"] = near["anchor"].map(id_of).astype("int64")
        pairs = spark.createDataFrame(
            near[["anchor", "place", "anchor_id", "id", "score"]].astype({"place": "int32"}), "anchor bigint, place int, anchor_id bigint, positive_id bigint, positive_score bigint")
        found = merged(far, negatives).join(pairs, ["anchor", "place"])
        found = found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        if total > per_pass:
            found = stored(found, "hard-negatives")
        out = found if out is None else out.unionByName(found)
    discard(anchors)
    if out is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return out


#: The query's rows in SQL.
ORACLE = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
),
pairs AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0
),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= 5
"""
