"""Whitening of embeddings by their leading principal components.

Sums and the centred covariance are added up in the tasks over the distinct vectors; only one dimensions x dimensions matrix
reaches the driver. It is made tridiagonal by Householder reflections, the leading eigenvalues are found by bisection on Sturm
counts, their vectors by inverse iteration (vectors of close eigenvalues are made orthogonal to each other again), and the
components go back to the tasks, which project every row.

Vectors are integers: x = floor(scale * component) + shift. Rows whose vector is null or has a null or non-finite entry are
dropped, as are vectors shorter than the longest, which lack entries. Each distinct vector counts once in the fit; rows that
repeat, and rows without an id, are returned like any other. A component whose variance is nothing but rounding is left out.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import discard, stored

#: Vectors of at most so many rows are multiplied at once.
BLOCK = 4096


def shifted_vectors(rows: DataFrame, vec_id: str, vector: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole."""
    sound = F.coalesce(F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale) + shift)
    return rows.where(sound & (F.size(vector) > 0)).select(F.col(vec_id).cast("bigint").alias("vec_id"), x.alias("x"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for batch in batches:
        for a in range(0, len(batch), BLOCK):
            part = batch.iloc[a : a + BLOCK]
            yield part, np.stack([np.asarray(v, np.int64) for v in part["x"]])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: longs if they hold it, else Python's integers."""
    most = max(int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0) // max(n, 1) + 1)
    if 2 * n * most < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(y: np.ndarray) -> np.ndarray:
    """Exact sum of squares of each row."""
    if y.dtype != object and y.size and y.shape[1] * int(np.abs(y).max()) ** 2 >= 2**63:
        y = y.astype(object)
    return (y * y).sum(1)


def fit_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and their sum in each dimension."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(dims, object)
        for part, x in _blocks(batches):
            n, total = n + len(part), total + x.sum(0)
        yield pd.DataFrame({"dim": np.arange(-1, dims), "s": [str(v) for v in [n, *total]]})

    sums = fit.mapInPandas(add, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = {r["dim"]: int(r["s"]) for r in sums.collect()}
    return got.get(-1, 0), [got.get(i, 0) for i in range(dims)]


def moments(fit: DataFrame, n: int, sums: list[int], projection: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the vectors, or of their projections, centred before multiplying."""
    size = len(sums) if projection is None else len(projection)
    above = np.triu_indices(size)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for _, x in _blocks(batches):
            y = (centred(x, n, sums) / n).astype(np.float64)
            if projection is not None:
                y = y @ projection.T
            total += y.T @ y
        yield pd.DataFrame({"i": above[0].astype(np.int32), "j": above[1].astype(np.int32), "s": total[above]})

    cells = fit.mapInPandas(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros((size, size))
    out[cells["i"], cells["j"]] = out[cells["j"], cells["i"]] = cells["s"] / n
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """(diagonal, off-diagonal, reflections) of a symmetric matrix after Householder reflections."""
    a = np.array(a, np.float64)
    n = len(a)
    mirrors: list[np.ndarray | None] = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        alpha = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= alpha
        size = np.linalg.norm(v)
        if size == 0:
            mirrors.append(None)
            continue
        v /= size
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = alpha
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def sturm_counts(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each x."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    n = np.zeros(len(x), int)
    q = np.ones(len(x))
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        n += q < 0
    return n


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection on Sturm counts."""
    n = len(d)
    reach = np.abs(np.concatenate([[0], e])) + np.abs(np.concatenate([e, [0]]))
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    width = np.finfo(float).eps * max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - 4 * width, high + 4 * width
    below = n - np.arange(1, k + 1)  # eigenvalues smaller than the wanted one
    while True:
        middle = (low + high) / 2
        if not ((middle > low) & (middle < high) & (high - low > width)).any():
            return middle
        more = sturm_counts(d, e, middle) > below
        low, high = np.where(more, low, middle), np.where(more, middle, high)


def _solver(d: np.ndarray, e: np.ndarray, shift: float, least: float):
    """Solves (T - shift) z = b by elimination with row exchanges; pivots are kept away from 0 by `least`."""
    n = len(d)
    a, b, c = [float(v) - shift for v in d], [float(v) for v in e] + [0.0], [0.0] * n
    steps = []
    for i in range(n - 1):
        below = float(e[i])
        if abs(below) > abs(a[i]):
            m = a[i] / below
            a[i], b[i], c[i], a[i + 1], b[i + 1] = below, a[i + 1], b[i + 1], b[i] - m * a[i + 1], -m * b[i + 1]
            steps.append((True, m))
        else:
            a[i] = a[i] if abs(a[i]) >= least else least
            m = below / a[i]
            a[i + 1] -= m * b[i]
            steps.append((False, m))
    a[-1] = a[-1] if abs(a[-1]) >= least else least

    def solve(right: np.ndarray) -> np.ndarray:
        z = [float(v) for v in right] + [0.0, 0.0]
        for i, (swap, m) in enumerate(steps):
            if swap:
                z[i], z[i + 1] = z[i + 1], z[i]
            z[i + 1] -= m * z[i]
        for i in range(n - 1, -1, -1):
            z[i] = (z[i] - (b[i] * z[i + 1] if i + 1 < n else 0.0) - (c[i] * z[i + 2] if i + 2 < n else 0.0)) / a[i]
        return np.array(z[:n])

    return solve


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, mirrors: list[np.ndarray | None]) -> np.ndarray:
    """Unit eigenvectors (rows) of the matrix that `tridiagonal` was given, by inverse iteration."""
    n, eps = len(d), np.finfo(float).eps
    size = max(float((np.abs(d) + np.abs(np.append(e, 0)) + np.abs(np.append(0, e))).max()), np.finfo(float).tiny)
    draws = np.random.default_rng(1)
    out = np.zeros((len(values), n))
    cluster, shift = 0, np.inf
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * size:
            cluster = i
        shift = min(value, shift - 2 * eps * size) if i > cluster else value
        solve = _solver(d, e, shift, eps * size)
        z = draws.standard_normal(n)
        for _ in range(6):
            z = solve(z / np.abs(z).max())
            z /= np.linalg.norm(z)
            for _ in range(2):
                z -= out[cluster:i].T @ (out[cluster:i] @ z)
            z /= np.linalg.norm(z)
        out[i] = z
    for k in range(len(mirrors) - 1, -1, -1):
        if mirrors[k] is not None:
            v = mirrors[k]
            out[:, k + 1 :] -= 2 * np.outer(out[:, k + 1 :] @ v, v)
    return out


def principal_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of the k largest eigenvalues that are more than rounding."""
    d, e, mirrors = tridiagonal(covariance)
    values = leading_eigenvalues(d, e, min(k, len(d)))
    values = values[values > max(len(d) * np.finfo(float).eps * values[0], 0)]
    return values, eigenvectors(d, e, values, mirrors)


def whitened(vectors: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row of `shifted_vectors` and component."""
    fields = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = stored(vectors.select("x").distinct(), "fit-list")
    dims = fit.agg(F.max(F.size("x"))).first()[0] or 0
    whole = fit.where(F.size("x") == dims)
    n, sums = fit_sums(whole, dims) if dims else (0, [])
    if not n:
        discard(fit)
        return vectors.sparkSession.createDataFrame([], fields)
    covariance = moments(whole, n, sums)
    values, axes = principal_components(covariance, components)
    scaled = axes / np.sqrt(values)[:, None]
    error = float(np.abs(moments(whole, n, sums, scaled) - np.eye(len(values))).max(initial=0))
    discard(fit)
    explained = values / np.trace(covariance) if len(values) else values
    k = len(values)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _blocks(batches):
            y = centred(x, n, sums)
            ids = part["vec_id"].astype("Int64")
            yield pd.DataFrame({
                "vec_id": ids.repeat(k).array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(part)), "n": n, "deviation": squares(y).repeat(k),
                "whitened": ((y / n).astype(np.float64) @ scaled.T).ravel(), "explained": np.tile(explained, len(part)), "identity_error": error})

    return vectors.where(F.size("x") == dims).mapInPandas(project, fields)
