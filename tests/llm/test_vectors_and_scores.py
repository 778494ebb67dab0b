"""Hard negatives (op11) and whitening (op13)."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import hard_negatives, queries, whitening
from tests.llm.conftest import SF
from tests.oracle_check import compare, connect

NAN, INF = float("nan"), float("inf")


def plain_negatives(rows, anchors, least=80, most=100, k=5):
    """rows: (id, label, vector of ints)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, label, x in rows:
        if a not in anchors:
            continue
        scored = [(-dot(x, y), i, other) for i, other, y in rows if i != a]
        near = sorted((s, i) for s, i, other in scored if other == label)[:k]
        for p, positive in near:
            fits = sorted((s, i) for s, i, other in scored if other != label and least * -p <= 100 * -s <= most * -p)[:k]
            out += [(a, positive, r, i, -p, -s) for r, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, anchors, **more):
    df = spark.createDataFrame(rows, "id bigint, label bigint, x array<bigint>").repartition(3)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("id").isin(list(anchors)), **more).collect())


def test_negatives_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (4, 12))
    rows = [(i, int(rng.integers(0, 3)), (centres[i % 4] + rng.integers(-9, 10, 12)).tolist()) for i in range(400)]
    rows += [(400 + i, i % 3, rows[7][2]) for i in range(40)] + [(500 + i, 1, [0] * 12) for i in range(3)] + [(600, 2, [1, 2, 3]), (601, 1, []), (5, 0, rows[9][2])]
    anchors = set(range(0, 640, 5))
    want = plain_negatives(rows, anchors)
    assert want and mined(spark, rows, anchors) == want
    assert mined(spark, rows, anchors, per_pass=17) == want


def test_bounds_hold_and_spare_products():
    rng = np.random.default_rng(5)
    x = (rng.integers(-300, 300, (8, 16))[np.arange(2000) % 8] + rng.integers(-4, 5, (2000, 16))).astype(float)
    a = x[:50] + rng.integers(-2, 3, (50, 16))
    order, parent, edge = hard_negatives.spanning_tree(a)
    tree = hard_negatives.Tree(0, np.arange(50), np.arange(50), a[order], parent, edge, float(hard_negatives.norms(a).max()))
    scores = tree.x @ x.T
    least = np.sort(scores, 1)[:, -20]
    seen, bounds_held = 0, True

    def wanted(c, low, high):
        nonlocal bounds_held
        bounds_held &= bool(((low <= scores[c]) & (scores[c] <= high)).all())
        return high >= least[c]

    for c, at, score in hard_negatives.bounded_scores(tree, x, wanted):
        seen += len(at)
        assert np.array_equal(score, scores[c][at]) and set(np.flatnonzero(scores[c] >= least[c])) <= set(at)
    assert bounds_held and seen < 0.8 * scores.size
    full = sorted(np.linalg.norm(a[i] - a[j]) for i in range(50) for j in range(i))
    assert edge[1:].sum() < 50 * np.median(full) and (parent[1:] < np.arange(1, 50)).all()


def test_large_integers_are_exact():
    x = np.array([[2**31, 3], [2**31 - 1, -7], [1, 1]])
    a = np.array([2**30 + 1, 5])
    want = [sum(int(p) * int(q) for p, q in zip(r, a)) for r in x]
    assert hard_negatives.products(hard_negatives.matrix(list(x)), hard_negatives.matrix([a])[0], 2.0**61).tolist() == want


def test_negatives_of_odd_rows(spark):
    rows = [
        (0, 1, [1.0, 2.0], "x"), (100, None, [1.0, 2.0], "x"), (200, 1, None, "x"), (300, 1, [1.0, None], None), (400, 1, [NAN, 1.0], "x"), (500, 1, [INF, 1.0], "x"),
        (None, 1, [1.0, 1.0], "x"), (3, 1, [1.0, 1.5], "x"), (4, 2, [1.0, 1.25], "x"), (4, 2, [1.0, 1.25], "x"), (5, 2, [-1.0, 0.0], "x"), (600, 3, [], "x"), (-100, 2, [0.5, 0.5], "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>, score string").selectExpr("*", "1 as id", "2 as anchor", "3 as x")
    whole = hard_negatives.integer_vectors(df, "vec_id", F.col("label"), "embedding")
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(whole, F.col("id") % 100 == 0).collect())
    plain = [(i, int(label), [int(np.floor(256 * c)) for c in v]) for i, label, v, _ in rows if i is not None and label is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    assert len(plain) == 7 and got == plain_negatives(plain, {0, 600, -100})
    assert hard_negatives.hard_negatives(whole.where("false"), F.col("id") % 100 == 0).count() == 0
    assert hard_negatives.hard_negatives(whole, F.lit(False)).count() == 0


def test_negatives_equal_their_sql(spark):
    name = "op11_hard_negatives"
    assert not compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)


def plain_whitening(x, k):
    fit = np.unique(x, axis=0)
    centre = fit.mean(0)
    values, axes = np.linalg.eigh((fit - centre).T @ (fit - centre) / len(fit))
    return len(fit), fit.sum(0), values[::-1][:k], axes.T[::-1][:k]


def test_whitening_equals_numpy(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    df = df.unionByName(df.where("vec_id < 50")).repartition(5)
    got = whitening.whitened(whitening.shifted_vectors(df, "vec_id", "embedding")).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 16 * df.count()
    got, pdf = got.drop_duplicates(["vec_id", "component"]), df.toPandas().drop_duplicates("vec_id").sort_values("vec_id")
    x = np.floor(64 * np.stack(pdf["embedding"]).astype(float)).astype(np.int64) + 1_000_000
    n, sums, values, axes = plain_whitening(x.astype(float), 16)
    assert set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    whole = got["whitened"].to_numpy().reshape(-1, 16)
    want = (x - sums / n) @ axes.T / np.sqrt(values)
    assert np.allclose(whole, want * np.sign((whole * want).sum(0)), atol=1e-8)
    assert got["deviation"].tolist() == [int(v) for v in ((n * x - sums.astype(np.int64)) ** 2).sum(1).repeat(16)]
    fit = np.unique(x, axis=0)
    assert np.allclose(got["explained"].to_numpy()[:16], values / np.trace(np.cov(fit.T, bias=True)), rtol=1e-9)


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5], [3, 3, 3, 1, 1, 0], [7, 0, 0, 0, 0, 0], [1, 1 - 1e-13, 1 - 2e-13, 1e-3, 1e-9, 0], [1e12, 1, 1, 1e-3, 0, 0]])
def test_components_of_known_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((6, 6)))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    got, axes = whitening.principal_components(a, 4)
    scale = max(values)
    assert np.allclose(got, np.linalg.eigvalsh(a)[::-1][: len(got)], atol=1e-13 * scale) and len(got) >= sum(v > 1e-8 * scale for v in values[:4])
    assert np.allclose(axes @ axes.T, np.eye(len(got)), atol=1e-10)
    assert np.abs(a @ axes.T - axes.T * got).max() < 1e-12 * scale


def test_diagonal_and_small_matrices():
    for a in (np.diag([2.0, 2.0, 1.0]), np.array([[4.0]]), np.array([[1.0, 1.0], [1.0, 1.0]])):
        values, axes = whitening.principal_components(a, 16)
        assert np.allclose(a @ axes.T, axes.T * values, atol=1e-12) and np.allclose(axes @ axes.T, np.eye(len(values)), atol=1e-12)
    assert len(whitening.principal_components(np.zeros((3, 3)), 16)[0]) == 0


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [0.0, 1.0, 0.25]), (2, [3.0, -1.0, 7.5]), (3, None), (4, [1.0, None, 1.0]), (5, [NAN, 1.0, 1.0]), (6, [-INF, 1.0, 1.0]), (7, []), (8, [1.0, 2.0]), (9, [2.5, 0.0, -4.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as x", "2 as n")
    vectors = whitening.shifted_vectors(df, "vec_id", "embedding")
    got = whitening.whitened(vectors).toPandas()
    assert set(got["n"]) == {4} and sorted(got["vec_id"].dropna().unique()) == [1, 2, 9] and got["component"].max() == 3
    assert len(got) == 5 * 3 and got["identity_error"].max() < 1e-9
    assert whitening.whitened(vectors.where("false")).count() == 0
    one = whitening.whitened(vectors.where("vec_id = 1"))
    assert one.count() == 0  # one distinct vector: no component has any variance


def test_exact_deviation_of_large_numbers():
    x = np.array([[2**40, -(2**40)], [5, 7]])
    y = whitening.centred(x, 10**9, [3, 10**30])
    assert y.tolist() == [[2**40 * 10**9 - 3, -(2**40) * 10**9 - 10**30], [5 * 10**9 - 3, 7 * 10**9 - 10**30]]
    assert whitening.squares(y)[1] == (5 * 10**9 - 3) ** 2 + (7 * 10**9 - 10**30) ** 2
