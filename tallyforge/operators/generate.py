"""Arithmetic problem tables: exponent grids, row generation on executors, dedupe, exact samples and subsets."""
from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge import constants as C
from tallyforge.functions import difficulty as D
from tallyforge.functions.text import base2_text, fixed_point, round_bits, sig_digits
from tallyforge.operators import draw as W
from tallyforge.operators.prefix import hash_slice, ranked_by_hash, running_totals
from tallyforge.session import bucket_count, materialized, shared_dir

CHUNK = 10_000


@dataclass(frozen=True)
class Settings:
    """Ranges and precision of generated numbers."""

    base: int = 10
    min_exponent: int = -14
    max_exponent: int = 15
    min_number: float = 1e-14
    max_number: float = 1e15
    significant_bits: int = 53
    distribution: str = "decimal_uniform"
    allow_negative: bool = True

    def __post_init__(self):
        if self.distribution not in C.DIGIT_DISTRIBUTIONS or self.distribution in ("decimal_triangular", "decimal_exponential"):
            raise ValueError(f"unsupported digit distribution: {self.distribution}")
        if self.significant_bits not in W.FLOATS:
            raise ValueError("significant_bits must be 53, 24 or 11")

    @property
    def significant_digits(self) -> int:
        return math.floor(self.significant_bits * math.log(2, self.base))

    @property
    def decimal(self) -> bool:
        return self.distribution == "decimal_uniform"

    @property
    def exponents(self) -> tuple[int, int]:
        """First exponent, and the one after the last."""
        low = math.floor(math.log(self.min_number, self.base))
        high = math.ceil(math.log(self.max_number, self.base))
        return max(self.min_exponent, low), min(self.max_exponent, high)


# ---- grid and allocation ----

def exponent_grid(spark: SparkSession, task: str, settings: Settings = Settings()) -> DataFrame:
    """Allowed exponents of a task: pairs for two operands, one (exp2 null) for powers and lists.

    At most a few thousand cells; it depends on the settings only.
    """
    low, high = settings.exponents
    if task in C.LIST_TASKS:
        return spark.range(low + 2, high - 2).select(F.col("id").cast("int").alias("exp1"), F.lit(None).cast("int").alias("exp2"))
    power = lambda c: F.pow(F.lit(float(settings.base)), c)
    first = spark.range(low, high).select(F.col("id").cast("int").alias("exp1"))
    first = first.filter((power(F.col("exp1") + 1) >= settings.min_number) & (power(F.col("exp1")) < settings.max_number))
    if task == "Exponentiation":
        return first.withColumn("exp2", F.lit(None).cast("int"))
    second = F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("exp2")
    grid = first.select("exp1", second).filter((power(F.col("exp2")) >= settings.min_number) & (power(F.col("exp2")) < settings.max_number))
    both, gap = F.col("exp1") + F.col("exp2"), F.col("exp1") - F.col("exp2")
    if task in ("Multiplication", "DivM"):
        return grid.filter((both + 2 > settings.min_exponent) & (both < settings.max_exponent))
    if task == "Division":
        return grid.filter((gap >= settings.min_exponent) & (gap < settings.max_exponent))
    if task == "Addition":
        return grid
    raise ValueError(f"unknown task: {task}")


def allocate(grid: DataFrame, n: int | Column, task: str) -> DataFrame:
    """Adds k, the rows to draw per cell: by closeness of exponents, or evenly."""
    n = F.lit(n) if isinstance(n, int) else n
    everything = Window.partitionBy(F.lit(0))
    if task not in ("Addition", "Exponentiation"):
        return grid.withColumn("k", F.ceil(n / F.count("*").over(everything)).cast("bigint"))
    distance = F.abs(F.col("exp1") - F.coalesce("exp2", F.lit(0)))
    t = grid.withColumn("_w", F.exp(F.lit(-0.15) * distance))
    k = F.floor(n * F.col("_w") / F.sum("_w").over(everything)).cast("bigint")
    return t.withColumn("k", F.greatest(F.lit(1).cast("bigint"), k)).drop("_w")


def expand(cells: DataFrame, seed: int, task: str, split: str, round_no: int = 0) -> DataFrame:
    """k rows per cell with a row key; cells are first cut into chunks that are spread over the cluster."""
    spark = cells.sparkSession
    chunk = F.explode(F.sequence(F.lit(0), F.ceil(F.col("k") / CHUNK).cast("bigint") - 1)).alias("chunk")
    t = cells.select("*", chunk).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "exp1", "exp2", "chunk")
    last = F.least(F.col("k"), (F.col("chunk") + 1) * CHUNK) - 1
    t = t.select("*", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("i")).drop("chunk", "k")
    return t.withColumn("row_key", F.xxhash64(F.lit(seed), F.lit(task), F.lit(split), F.lit(round_no), "exp1", "exp2", "i")).drop("i")


def digit_plan(u: Column, distribution: str, low: Column | int, high: Column | int) -> Column:
    """Number of significant bits or digits from a uniform number: uniform, triangular (peak at the top) or exponential (rate 0.06).

    The uniform forms include `high`; `full` always gives it.
    """
    low, high = (F.lit(float(v)) if isinstance(v, int) else v.cast("double") for v in (low, high))
    kind = distribution.split("_")[-1]
    if kind == "full":
        return high.cast("int")
    if kind == "uniform":
        return F.floor(low + u * (high - low + 1)).cast("int")
    if kind == "triangular":
        return F.floor(low + F.sqrt(u) * (high - low)).cast("int")
    if kind == "exponential":
        return F.floor(low + F.log(F.lit(1.0) + u * (F.exp(F.lit(0.06) * (high - low)) - 1)) / F.lit(0.06)).cast("int")
    raise ValueError(f"unknown digit distribution: {distribution}")


# ---- rows of two operands, on Arrow batches ----

def _signs(x: np.ndarray, y: np.ndarray, u: np.ndarray, allow: bool) -> tuple[np.ndarray, np.ndarray]:
    case = W.whole(u, 0, 5) if allow else np.zeros(len(u), dtype=np.int64)
    return np.where((case == 2) | (case == 4), -x, x), np.where((case == 3) | (case == 4), -y, y)


def _share(keys: np.ndarray, st: Settings, total_high: int, part_high: int, salt: int, total: np.ndarray) -> np.ndarray:
    """Digits of the first operand: triangular over the upper half of the total."""
    least, most = np.maximum(1, total // 2), np.minimum(total - 1, part_high)
    drawn = W.triangular(W.uniform(keys, salt), least, np.minimum(np.maximum(least + 1, total // 2), np.maximum(most, least + 1)), np.maximum(most, least + 1))
    return np.where(least < most, np.floor(drawn).astype(np.int64), least)


def _bit_total(keys: np.ndarray, st: Settings, high: int, salt: int) -> np.ndarray:
    u, n = W.uniform(keys, salt), len(keys)
    if st.distribution == "binary_uniform":
        return W.whole(u, 2, high + 1)
    if st.distribution == "binary_triangular":
        return np.floor(W.triangular(u, 2, high, high)).astype(np.int64)
    if st.distribution == "binary_exponential":
        return np.floor(W.truncated_exponential(u, 2, high, 0.06)).astype(np.int64)
    return np.full(n, high, dtype=np.int64)


def _range(exp: np.ndarray, st: Settings) -> tuple[np.ndarray, np.ndarray]:
    e = exp.astype(np.float64)
    return np.maximum(st.min_number, float(st.base) ** e), np.minimum(st.max_number, float(st.base) ** (e + 1))


def _operand_pair(keys, salt, lo1, hi1, lo2, hi2, st: Settings, total):
    """Two signed operands whose digits (or bits) together do not exceed the total."""
    x, y = W.between(W.uniform(keys, salt, 1), lo1, hi1), W.between(W.uniform(keys, salt, 2), lo2, hi2)
    x, y = _signs(x, y, W.uniform(keys, salt, 3), st.allow_negative)
    if st.decimal:
        cap = st.significant_digits + 2
        s = _share(keys, st, 2 * cap, cap, salt * 7 + 4, total)
        tx = W.round_texts(x, s)
        left = np.minimum(total - np.array([W.digit_count(t) for t in tx], dtype=np.int64), cap)
        ty = W.round_texts(y, left)
        vx, vy = np.array([float(t) for t in tx]), np.array([float(t) for t in ty])
        return W.round_bits(vx, st.significant_bits), W.round_bits(vy, st.significant_bits), tx, ty
    s = _share(keys, st, 2 * st.significant_bits, st.significant_bits, salt * 7 + 4, total)
    vx = W.round_bits(x, s)
    vy = W.round_bits(y, np.minimum(total - W.bit_count(vx), st.significant_bits))
    return vx, vy, W.fixed_texts(vx), W.fixed_texts(vy)


def _compute(op: Callable, x: np.ndarray, y: np.ndarray, st: Settings) -> np.ndarray:
    """Result in the chosen float type, then cut to the digits (or bits) a result may have."""
    dtype = W.FLOATS[st.significant_bits]
    with np.errstate(all="ignore"):
        out = op(x.astype(dtype), y.astype(dtype)).astype(np.float64)
    return W.round_result(out, st.significant_digits) if st.decimal else W.round_bits(out, st.significant_bits)


_PAIR_SCHEMA = (
    "row_key bigint, num1 string, num2 string, result string, num1_value double, num2_value double, result_value double, "
    "num1_exp int, num2_exp int, operator string, quotient_precision int, divisor_precision int, tries int"
)


def _frame(keys, tx, ty, vx, vy, res, e1, e2, ok, **more) -> pd.DataFrame:
    n = len(keys)
    out = pd.DataFrame({
        "row_key": keys, "num1": tx, "num2": ty, "result": W.fixed_texts(res), "num1_value": vx, "num2_value": vy, "result_value": res,
        "num1_exp": e1, "num2_exp": e2, "operator": more.get("operator", [None] * n),
        "quotient_precision": more.get("quotient_precision", np.zeros(n, dtype=np.int64)),
        "divisor_precision": more.get("divisor_precision", np.zeros(n, dtype=np.int64)), "tries": more.get("tries", np.ones(n, dtype=np.int64)),
    })
    return out[ok]


def _addition_batch(b: pd.DataFrame, st: Settings) -> pd.DataFrame:
    keys, e1, e2 = b["row_key"].to_numpy(), b["exp1"].to_numpy(), b["exp2"].to_numpy()
    lo1, hi1 = _range(e1, st)
    lo2, hi2 = _range(e2, st)
    if st.decimal:
        total = W.whole(W.uniform(keys, 11), 2, 2 * (st.significant_digits + 2))
        x, y, tx, ty = _operand_pair(keys, 0, lo1, hi1, lo2, hi2, st, total)
    else:
        x, y = W.between(W.uniform(keys, 0, 1), lo1, hi1), W.between(W.uniform(keys, 0, 2), lo2, hi2)
        x, y = _signs(x, y, W.uniform(keys, 0, 3), st.allow_negative)
        tx, ty = W.fixed_texts(x), W.fixed_texts(y)
        x, y = W.round_bits(x, st.significant_bits), W.round_bits(y, st.significant_bits)
    swap = W.uniform(keys, 12) < 0.5
    tx, ty = np.where(swap, ty, tx), np.where(swap, tx, ty)
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    minus = W.uniform(keys, 13) < 0.5
    res = _compute(lambda p, q: np.where(minus, p - q, p + q), x, y, st)
    return _frame(keys, tx, ty, x, y, res, np.where(swap, e2, e1), np.where(swap, e1, e2), np.isfinite(res), operator=np.where(minus, "-", "+"))


def _multiplication_batch(b: pd.DataFrame, st: Settings, tries: int = 100) -> pd.DataFrame:
    """Operands are redrawn until the product is in bounds; rows that never get there are left out."""
    keys, e1, e2 = b["row_key"].to_numpy(), b["exp1"].to_numpy(), b["exp2"].to_numpy()
    n = len(keys)
    total = W.whole(W.uniform(keys, 11), 2, 2 * (st.significant_digits + 2)) if st.decimal else _bit_total(keys, st, 2 * st.significant_bits, 11)
    x, y, res, used = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
    tx, ty = np.array([""] * n, dtype=object), np.array([""] * n, dtype=object)
    open_ = np.arange(n)
    for attempt in range(tries):
        if not len(open_):
            break
        lo1, hi1 = _range(e1[open_], st)
        lo2, hi2 = _range(e2[open_], st)
        vx, vy, sx, sy = _operand_pair(keys[open_], attempt, lo1, hi1, lo2, hi2, st, total[open_])
        r = _compute(lambda p, q: p * q, vx, vy, st)
        x[open_], y[open_], res[open_], used[open_] = vx, vy, r, attempt + 1
        tx[open_], ty[open_] = sx, sy
        good = np.isfinite(r) & (np.abs(r) >= st.min_number) & (np.abs(r) <= st.max_number)
        open_ = open_[~good]
    ok = np.ones(n, dtype=bool)
    ok[open_] = False
    swap = W.uniform(keys, 12) < 0.5
    tx, ty = np.where(swap, ty, tx), np.where(swap, tx, ty)
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    return _frame(keys, tx, ty, x, y, res, np.where(swap, e2, e1), np.where(swap, e1, e2), ok, tries=used)


def _division_batch(b: pd.DataFrame, st: Settings, tries: int = 1000) -> pd.DataFrame:
    """Quotient and divisor are drawn with controlled digits; the dividend follows and must fit its range."""
    keys, e1, e2 = b["row_key"].to_numpy(), b["exp1"].to_numpy(), b["exp2"].to_numpy()
    n, bits, digits = len(keys), st.significant_bits, st.significant_digits
    lo_q, hi_q = np.clip(e1 - e2 - 2, -14, 14), np.clip(e1 - e2 + 2, -14, 14)
    if st.decimal:
        q_digits = W.whole(W.uniform(keys, 21), 2, digits + 2)
        total = W.whole(W.uniform(keys, 22), 2, 2 * (digits + 2))
        d_digits = _share(keys, st, 0, digits + 2, 23, total)
    else:
        q_digits = _bit_total(keys, st, bits, 21)
        d_digits = _share(keys, st, 0, bits, 23, _bit_total(keys, st, 2 * bits, 22))
    x, y, res, used = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
    tx, ty = np.array([""] * n, dtype=object), np.array([""] * n, dtype=object)
    open_ = np.arange(n)
    for attempt in range(tries):
        if not len(open_):
            break
        k = keys[open_]
        q = W.between(W.uniform(k, attempt, 1), 10.0 ** lo_q[open_].astype(float), 10.0 ** hi_q[open_].astype(float))
        d = W.between(W.uniform(k, attempt, 2), 10.0 ** e2[open_].astype(float), 10.0 ** (e2[open_] + 1).astype(float))
        if st.decimal:
            q = np.array([float(t) for t in W.round_texts(q, q_digits[open_])])
            td = W.round_texts(d, d_digits[open_])
            d = np.array([float(t) for t in td])
            tn = W.round_texts(q * d, digits)
            num = np.array([float(t) for t in tn])
        else:
            q, d = W.round_bits(q, q_digits[open_]), W.round_bits(d, d_digits[open_])
            num = W.round_bits(q * d, bits)
            td, tn = W.fixed_texts(d), W.fixed_texts(num)
        size = np.abs(num)
        fits = (d != 0) & (size >= 1e-15) & (size <= 1e15) & (size >= 10.0 ** (e1[open_] - 1).astype(float)) & (size < 10.0 ** (e1[open_] + 2).astype(float))
        num_s, d_s = _signs(num, d, W.uniform(k, attempt, 3), st.allow_negative)
        tn = [("-" + t if v < 0 else t) for t, v in zip(tn, num_s.tolist())]
        td = [("-" + t if v < 0 else t) for t, v in zip(td, d_s.tolist())]
        r = _compute(lambda p, s: p / np.where(s == 0, 1, s), num_s, d_s, st)
        good = fits & np.isfinite(r) & (np.abs(r) >= 1e-15) & (np.abs(r) <= 1e15)
        x[open_], y[open_], res[open_], used[open_] = num_s, d_s, r, attempt + 1
        tx[open_], ty[open_] = tn, td
        open_ = open_[~good]
    ok = np.ones(n, dtype=bool)
    ok[open_] = False
    return _frame(keys, tx, ty, x, y, res, e1, e2, ok, quotient_precision=q_digits, divisor_precision=d_digits, tries=used)


def _power_batch(b: pd.DataFrame, st: Settings) -> pd.DataFrame:
    keys, base_keys, e1, n2 = b["row_key"].to_numpy(), b["base_key"].to_numpy(), b["exp1"].to_numpy(), b["n2"].to_numpy()
    lo, hi = _range(e1, st)
    x = W.between(W.uniform(base_keys, 1), lo, hi)
    y = np.where(n2 > 1, n2.astype(float), 1.0 / n2)
    if st.allow_negative:
        x = np.where((y > 1) & (W.uniform(keys, 2) < 1 / 3), -x, x)
    y = np.where(W.uniform(keys, 3) < 0.5, -y, y)
    if st.decimal:
        tx = W.round_texts(x, W.whole(W.uniform(base_keys, 4), 2, st.significant_digits + 2))
        x = W.round_bits(np.array([float(t) for t in tx]), st.significant_bits)
    else:
        x = W.round_bits(x, _bit_total(base_keys, st, st.significant_bits, 4))
        tx = W.fixed_texts(x)
    res = _compute(lambda p, q: np.power(p, q), x, y, st)
    size = np.abs(res)
    ok = np.isfinite(res) & (x != 0) & (np.abs(x) != 1) & (np.abs(y) != 1) & (size >= st.min_number) & (size <= st.max_number)
    out = _frame(keys, tx, W.fixed_texts(y), x, y, np.where(ok, res, 0.0), e1, np.zeros(len(keys), dtype=np.int64), ok)
    return out


def _batched(make: Callable[[pd.DataFrame, Settings], pd.DataFrame], st: Settings) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield make(b, st)
    return run


def _kept_bits(x: Column | str, bits: int) -> Column:
    return round_bits(x, bits) if bits < 53 else (F.col(x) if isinstance(x, str) else x)


def _with_digits(t: DataFrame, columns: list[str], base: int) -> DataFrame:
    suffix = "_base_2" if base == 2 else ""
    return t.select("*", *[sig_digits(f"{c}{suffix}").alias(f"{c}_significant_digits_base_{base}") for c in columns])


def _rows_like(like: DataFrame, columns: list[str], grid: DataFrame, cell: list[str], seed: int, task: str, split: str, round_no: int) -> DataFrame:
    """Rows to draw a problem for: one for each row of `like` whose cell the task allows, keyed by all its columns."""
    key = F.xxhash64(F.lit(seed), F.lit(task), F.lit(split), F.lit(round_no), *like.columns)
    rows = like.select(*[F.col(c).cast("int").alias(c) for c in columns], key.alias("row_key"))
    return rows.join(F.broadcast(grid.select(*cell)), cell, "left_semi")  # a few thousand cells at most


def _pair_problems(spark: SparkSession, task: str, n: int, split: str, st: Settings, seed: int, round_no: int, like: DataFrame | None = None) -> DataFrame:
    grid = exponent_grid(spark, task, st)
    cell = ["exp1"] if task == "Exponentiation" else ["exp1", "exp2"]
    rows = expand(allocate(grid, n, task), seed, task, split, round_no) if like is None else _rows_like(like, cell, grid, cell, seed, task, split, round_no)
    bits, double = st.significant_bits, st.significant_bits == 53
    result = {"Addition": "sum", "Multiplication": "prod", "DivM": "quot", "Division": "quot", "Exponentiation": "exp"}[task]
    if task == "Exponentiation":
        span = F.abs("exp1") + 1
        low, high = F.ceil(F.lit(st.min_exponent + 1) / span).cast("int"), F.floor(F.lit(st.max_exponent - 1) / span).cast("int")
        rows = rows.filter(low != high).select("exp1", F.col("row_key").alias("base_key"), F.explode(F.sequence(low, high)).alias("n2"))
        rows = rows.filter(~F.col("n2").isin(0, 1)).withColumn("row_key", F.xxhash64("base_key", "n2"))
    make = {"Addition": _addition_batch, "Multiplication": _multiplication_batch, "DivM": _multiplication_batch, "Division": _division_batch,
            "Exponentiation": _power_batch}[task]
    t = rows.mapInPandas(_batched(make, st), _PAIR_SCHEMA)
    b2 = lambda c: base2_text(_kept_bits(c, bits))
    t = t.withColumn("num1_base_2", b2("num1_value")).withColumn("num2_base_2", b2("num2_value")).withColumn(f"{result}_base_2", b2("result_value"))
    t = t.withColumnRenamed("result", result)
    num1, num2, out = F.col("num1"), F.col("num2"), F.col(result)
    at_most = lambda cap, c: F.least(F.lit(cap), c).cast("int")
    within = lambda lo, hi, c: F.greatest(F.lit(lo), F.least(F.lit(hi), c)).cast("int")
    if task == "Addition":
        t = t.withColumn("difficulty", at_most(90 if double else 50, D.difficulty_add(["num1_base_2", "num2_base_2"], f"{result}_base_2")))
        t = t.withColumn("difficulty_sd", at_most(60 if double else 32, D.difficulty_add([num1, num2], out)))
    elif task in ("Multiplication", "DivM"):
        t = t.withColumn("difficulty_sd", at_most(32, D.difficulty_mul(num1, num2)))
        if task == "DivM":
            # the same rows read as a division by the reciprocal; difficulty_sd stays that of the factor
            t = t.withColumn("num2_value", F.lit(1.0) / F.col("num2_value")).withColumn("num2_base_2", b2("num2_value"))
            t = t.withColumn("num2", fixed_point("num2_value")).withColumn("num2_exp", -F.col("num2_exp"))
        t = t.withColumn("difficulty", at_most(60 if double else 32, D.difficulty_mul("num1_base_2", "num2_base_2")))
    elif task == "Division":
        inverse = b2(F.lit(1.0) / F.col("num2_value"))
        t = t.withColumn("difficulty", within(30 if double else 15, 60 if double else 30, D.difficulty_mul("num1_base_2", inverse, f"{result}_base_2")))
        t = t.withColumn("difficulty_sd", D.difficulty_mul(num1, num2, out).cast("int"))
    else:
        t = t.withColumn("difficulty", within(5 if double else 0, 58 if double else 23, D.difficulty_pow("num1_base_2", "num2_base_2", f"{result}_base_2")))
        t = t.withColumn("difficulty_sd", D.difficulty_pow(num1, num2, out))
        size = F.abs("num2_value")
        t = t.withColumn("num2_exp", F.when(size > 1, size).otherwise(F.lit(-1.0) / size))
    t = _with_digits(t, ["num1", "num2", result], 2)
    if task in ("Addition", "Division"):
        t = _with_digits(t, ["num1", "num2", result], 10)
    drop = ["row_key", "num1_value", "num2_value", "result_value", "tries"]
    if task != "Addition":
        drop.append("operator")
    if task != "Division":
        drop += ["quotient_precision", "divisor_precision"]
    return t.drop(*drop)


# ---- rows of lists ----

_LIST_SCHEMA = (
    "row_key bigint, list1 array<string>, list1_value array<double>, mean string, mean_value double, std string, std_value double, "
    "ref string, ref_value double, position int, list_len int, exp int, spread int, max_num_significant_bits int, max_num_significant_digits int"
)


def _list_batch(task: str) -> Callable[[pd.DataFrame, Settings], pd.DataFrame]:
    def make(b: pd.DataFrame, st: Settings) -> pd.DataFrame:
        return pd.concat([_lists_of(task, g, st, int(k)) for k, g in b.groupby("list_len", sort=False)], ignore_index=True)
    return make


def _list_precision(keys, exp, spread, st: Settings) -> np.ndarray:
    """Bits or digits of the numbers of a list; enough to tell them apart within the spread."""
    u, bits, digits = W.uniform(keys, 31), st.significant_bits, st.significant_digits
    if st.decimal:
        return W.whole(u, np.clip(exp - spread + 2, 1, digits + 2), digits + 3)
    least = (exp - spread + 2) * math.log2(10)
    if st.distribution == "binary_uniform":
        return W.whole(u, np.floor(np.clip(least, 10, bits)), bits + 1)
    if st.distribution == "binary_triangular":
        return np.floor(W.triangular(u, np.clip(least, 10, bits - 1), bits, bits)).astype(np.int64)
    if st.distribution == "binary_exponential":
        return np.floor(W.truncated_exponential(u, np.clip(least, 10, bits - 1), bits, 0.06)).astype(np.int64)
    return np.full(len(keys), bits, dtype=np.int64)


def _lists_of(task: str, b: pd.DataFrame, st: Settings, k: int, tries: int = 20) -> pd.DataFrame:
    keys, exp, spread = b["row_key"].to_numpy(), b["exp1"].to_numpy(), b["spread"].to_numpy()
    n, dtype = len(keys), W.FLOATS[st.significant_bits]
    precision = _list_precision(keys, exp, spread, st)
    low, high = _range(exp, st)
    width = float(st.base) ** spread.astype(float)
    values, done = np.zeros((n, k)), np.zeros(n, dtype=bool)
    texts = np.full((n, k), "", dtype=object)
    for attempt in range(tries):
        at = np.flatnonzero(~done)
        if not len(at):
            break
        kk = keys[at]
        mean = W.between(W.uniform(kk, attempt, 1), low[at], high[at])
        u = np.stack([W.uniform(kk, attempt, 2, i) for i in range(k)], axis=1)
        y, feasible = W.lists_around(mean, width[at], u, precision[at], not st.decimal)
        t = np.array(W.round_texts(y, precision[at][:, None]), dtype=object).reshape(len(at), k) if st.decimal else None
        if st.decimal:
            y = np.array([[float(s) for s in row] for row in t]).reshape(len(at), k)
        else:
            t = np.array([[W.fixed_text(v) for v in row] for row in y.tolist()], dtype=object).reshape(len(at), k)
        with np.errstate(all="ignore"):
            m, s = y.astype(dtype).mean(axis=1).astype(float), y.astype(dtype).std(axis=1).astype(float)
        size = np.abs(y)
        good = feasible & (((size >= st.min_number) & (size < st.max_number)) | (y == 0)).all(axis=1)
        good &= ((k % 2 == 1) | (m != 0)) & (s >= st.min_number) & (s < st.max_number)
        if task == "Interval":
            ordered = np.sort(y, axis=1)
            good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
        values[at[good]], texts[at[good]], done[at[good]] = y[good], t[good], True
    with np.errstate(all="ignore"):
        mean, std = values.astype(dtype).mean(axis=1).astype(float), values.astype(dtype).std(axis=1).astype(float)
    cut = (lambda v: W.round_result(v, st.significant_digits)) if st.decimal else (lambda v: W.round_bits(v, precision))
    mean, std = cut(mean), cut(std)
    ref, ref_text, place = np.zeros(n), [None] * n, np.zeros(n, dtype=np.int64)
    if task == "Interval":
        order = np.argsort(values, axis=1, kind="stable")
        values, texts = np.take_along_axis(values, order, axis=1), np.take_along_axis(texts, order, axis=1)
        ref, ref_text, place, found = _references(keys, values, width / k, precision, st)
        done &= found
    out = pd.DataFrame({
        "row_key": keys, "list1": list(texts), "list1_value": list(values), "mean": W.fixed_texts(mean), "mean_value": mean, "std": W.fixed_texts(std), "std_value": std,
        "ref": ref_text, "ref_value": ref, "position": place, "list_len": k, "exp": exp, "spread": spread,
        "max_num_significant_bits": None if st.decimal else precision, "max_num_significant_digits": precision if st.decimal else None,
    })
    return out[done]


def _references(keys, values, step, precision, st: Settings, tries: int = 20):
    """A number from one of the k+1 intervals of a sorted list, positions tried in hashed order."""
    n, k = values.shape
    order = np.argsort(np.stack([W.uniform(keys, 41, i) for i in range(k + 1)], axis=1), axis=1)
    ref, text, place, found = np.zeros(n), np.array([None] * n, dtype=object), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for turn in range(k + 1):
        for attempt in range(tries):
            at = np.flatnonzero(~found)
            if not len(at):
                return ref, text, place, found
            p, v = order[at, turn], values[at]
            first, last = v[:, 0], v[:, -1]
            low = np.where(p > 0, v[np.arange(len(at)), np.maximum(p - 1, 0)], first - step[at])
            high = np.where(p < k, v[np.arange(len(at)), np.minimum(p, k - 1)], last + step[at])
            x = W.between(W.uniform(keys[at], 42, turn, attempt), low, high)
            if st.decimal:
                t = W.round_texts(x, precision[at])
                x = np.array([float(s) for s in t])
            else:
                x = W.round_bits(x, precision[at])
                t = W.fixed_texts(x)
            size = np.abs(x)
            good = (((size >= st.min_number) & (size < st.max_number)) | (x == 0)) & (low <= x) & (x < high)
            hit = at[good]
            ref[hit], place[hit], found[hit] = x[good], p[good], True
            text[hit] = np.array(t, dtype=object)[good]
    return ref, text, place, found


def _list_problems(spark: SparkSession, task: str, n: int, split: str, st: Settings, seed: int, round_no: int, like: DataFrame | None = None) -> DataFrame:
    low, high = st.exponents
    grid, digits = exponent_grid(spark, task, st), st.significant_digits
    top = F.col("exp1") + (digits + 2 if task in ("Mean", "Std") else 2)
    spreads = F.sequence(F.greatest(F.lit(low + 2), F.col("exp1") - digits), F.least(top, F.lit(high - 2)) - 1)
    if like is None:
        rows = expand(allocate(grid, n, task), seed, task, split, round_no)
        rows = rows.withColumn("list_len", F.explode(F.array(*[F.lit(k) for k in (2, 3, 4, 5)]))).withColumn("spread", F.explode(spreads))
        rows = rows.withColumn("row_key", F.xxhash64("row_key", "list_len", "spread"))
    else:
        rows = _rows_like(like, ["exp1", "list_len", "spread"], grid, ["exp1"], seed, task, split, round_no)
        rows = rows.filter(F.col("list_len").between(2, 5) & F.array_contains(spreads, F.col("spread")))
    t = rows.mapInPandas(_batched(_list_batch(task), st), _LIST_SCHEMA)
    bits = st.significant_bits
    t = t.withColumn("list_base_2", F.transform("list1_value", lambda v: base2_text(_kept_bits(v, bits))))
    double = bits == 53
    if task in ("Mean", "Std"):
        word = task.lower()
        t = t.withColumn(f"{word}_base_2", base2_text(_kept_bits(f"{word}_value", bits)))
        t = t.withColumn("difficulty", F.least(F.lit(155 if double else 95), D.difficulty_mean(F.col("list_base_2"), 2)).cast("int"))
        t = t.withColumn("difficulty_sd", F.least(F.lit(80), D.difficulty_mean(F.col("list1"))).cast("int"))
        extra = [word, f"{word}_base_2", "difficulty", "difficulty_sd"]
    elif task == "MinMax":
        at = lambda f, c: F.element_at(c, F.array_position(F.col("list1_value"), f("list1_value")).cast("int"))
        for word, short, f in (("minimum", "min", F.array_min), ("maximum", "max", F.array_max)):
            t = t.withColumn(word, at(f, F.col("list1"))).withColumn(f"{short}_base_2", at(f, F.col("list_base_2")))
            t = t.withColumn(f"{word}_difficulty", D.difficulty_minmax(F.col("list_base_2"), f"{short}_base_2"))
            t = t.withColumn(f"{word}_difficulty_sd", D.difficulty_minmax(F.col("list1"), word))
        extra = ["minimum", "min_base_2", "maximum", "max_base_2", *[f"{w}_difficulty{s}" for w in ("minimum", "maximum") for s in ("", "_sd")]]
    elif task == "Interval":
        t = t.withColumn("ref_base_2", base2_text(_kept_bits("ref_value", bits)))
        t = t.withColumn("difficulty", D.difficulty_minmax(F.col("list_base_2"), "ref_base_2")).withColumn("difficulty_sd", D.difficulty_minmax(F.col("list1"), "ref"))
        extra = ["ref", "position", "ref_base_2", "difficulty", "difficulty_sd"]
    else:
        pairs = F.sort_array(F.arrays_zip(F.col("list1_value").alias("v"), F.col("list1").alias("t")))
        t = t.withColumn("_sorted", pairs).withColumn("asc", F.transform("_sorted", lambda p: p["t"])).withColumn("desc", F.reverse("asc"))
        t = t.withColumn("difficulty", D.difficulty_sort(F.col("list_base_2"))).withColumn("difficulty_sd", D.difficulty_sort(F.col("list1")))
        extra = ["asc", "desc", "difficulty", "difficulty_sd"]
    return t.select("list1", *extra, "list_len", "exp", "spread", "max_num_significant_bits", "max_num_significant_digits")


def generate(spark: SparkSession, task: str, n: int = 0, split: str = "train", settings: Settings = Settings(), seed: int = 42, round_no: int = 0,
             like: DataFrame | None = None) -> DataFrame:
    """About n problems of a task (list tasks: n per list length and spread), the same for any partitioning.

    With `like`, instead a fresh problem for each of its rows, in the row's cell: exponents exp1 and exp2 of the operands, or exp1,
    list_len and spread of a list. Rows whose cell the task does not allow, and draws that stay out of bounds, are left out.
    """
    if task not in C.GENERATED_TASKS:
        raise ValueError(f"unknown task: {task}")
    build = _list_problems if task in C.LIST_TASKS else _pair_problems
    return build(spark, task, n, split, settings, seed, round_no, like)


# ---- whole tables ----

def problem_keys(df: DataFrame) -> list[str]:
    return [c for c in ("num1", "num2", "list1", "ref") if c in df.columns]


def dedupe_problems(df: DataFrame, keys: list[str] | None = None, order: Column | None = None) -> DataFrame:
    """One row per problem; the operator is not part of a problem's key. The first row in the order stays (default: of smallest hash)."""
    keys = keys or problem_keys(df)
    order = F.xxhash64(*df.columns) if order is None else order
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_row"))
    return kept.select("_row.*")


def exact_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42, hashed: Column | None = None) -> DataFrame:
    """n rows without replacement: those of smallest hash (by default a seeded one of the keys; ties go by the keys).

    Hash slices are counted first. Slices below the cut are kept as they are, and only the slice at the cut is ranked.
    """
    slices = max(64, bucket_count(df))
    t = df.withColumn("_h", F.xxhash64(F.lit(seed), *keys) if hashed is None else hashed)
    t = t.withColumn("_slice", hash_slice(F.col("_h"), slices))
    # one row per slice
    before = F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    sizes = t.groupBy("_slice").agg(F.count("*").alias("_n")).select(F.col("_slice").alias("_s"), "_n", before.alias("_before"))
    joined = t.join(F.broadcast(sizes.filter(F.col("_before") < n)), F.col("_slice") == F.col("_s"))
    whole = joined.filter(F.col("_before") + F.col("_n") <= n)
    cut = joined.filter(F.col("_before") + F.col("_n") > n)
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy("_h", *keys))
    cut = cut.withColumn("_rn", rank).filter(F.col("_before") + F.col("_rn") <= n)
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


def split_leak_check(train: DataFrame, *held_out: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Training problems that no held-out split has; the keys default to what makes a problem."""
    keys = keys or problem_keys(train)
    for split in held_out:
        found = split.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        train = train.join(found, same, "left_anti")
    return train


def generate_until(spark: SparkSession, task: str, n: int, split: str = "train", settings: Settings = Settings(), seed: int = 42,
                   first: int = 20, rounds: int = 10) -> DataFrame:
    """Exactly n distinct problems: rounds of generation sized by the yield so far.

    Every round is written to the shared folder, so later rounds and retries read files and never regenerate.
    """
    root = f"{shared_dir(spark)}/problems-{uuid.uuid4().hex}"
    size, have, keys = first, 0, None
    for i in range(rounds):
        batch = dedupe_problems(generate(spark, task, size, split, settings, seed, i))
        keys = problem_keys(batch)
        if i:
            batch = batch.join(spark.read.parquet(root).select(*keys), keys, "left_anti")
        batch.write.parquet(f"{root}/round={i}")
        gained = spark.read.parquet(f"{root}/round={i}").count()
        have += gained
        if have >= n or gained == 0:
            break
        size = math.ceil((n - have) / (gained / size))
    if have < n:
        raise ValueError(f"only {have} of {n} problems could be generated")
    return exact_sample(spark.read.parquet(root).drop("round"), n, keys, seed)


def stratified_subset(df: DataFrame, n: int, strata: list[str], seed: int = 42) -> DataFrame:
    """Exactly n rows, proportional to the strata (largest remainders); strata of one row share what is left over.

    With p = n / rows in larger strata, single rows contribute min(their number, int(n(1-p))).
    """
    counts = materialized(df.groupBy(*strata).agg(F.count("*").alias("_n")), "strata")
    valid = F.col("_n") >= 2
    totals = counts.agg(F.struct(
        F.sum(F.when(valid, F.col("_n")).otherwise(0)).alias("valid"), F.sum(F.when(valid, 0).otherwise(F.col("_n"))).alias("single")
    )).scalar()
    q = counts.withColumn("_t", totals)
    room = F.lit(n) * (F.lit(1.0) - F.lit(n) / F.col("_t.valid"))
    q = q.withColumn("_singles", F.least(F.col("_t.single"), F.greatest(F.floor(room), F.lit(0))).cast("bigint"))
    exact = F.col("_n") * (F.lit(n) - F.col("_singles")) / F.col("_t.valid")
    q = q.withColumn("_floor", F.when(valid, F.floor(exact)).otherwise(0).cast("bigint")).withColumn("_rest", F.when(valid, F.round(exact - F.floor(exact), 9)).otherwise(-1.0))
    # remainders are ranked over the table of strata: by value first, then by the stratum itself
    q = q.withColumn("_slice", F.floor((F.lit(1.0) - F.col("_rest")) * 1000).cast("int")).withColumn("_down", -F.col("_rest"))
    short = q.agg((F.lit(n) - F.first("_singles") - F.sum("_floor"))).scalar()
    q = running_totals(q, [], ["_down", *strata], {"_rank": F.lit(1).cast("bigint")}).withColumn("_short", short)
    q = q.withColumn("_quota", F.when(valid, F.col("_floor") + (F.col("_rank") <= F.col("_short")).cast("bigint")))
    match = [F.col(f"_k{i}").eqNullSafe(F.col(s)) for i, s in enumerate(strata)]
    quota = materialized(q.select(*[F.col(s).alias(f"_k{i}") for i, s in enumerate(strata)], "_quota", "_singles"), "quotas")
    joined = df.join(quota, match).drop(*[f"_k{i}" for i in range(len(strata))])
    hashed = F.xxhash64(F.lit(seed), *df.columns)
    # strata of one row are one group, so that all rows are ranked in one go
    grouped = joined.withColumn("_group", F.when(F.col("_quota").isNotNull(), F.struct(*strata))).withColumn("_most", F.coalesce("_quota", "_singles"))
    return ranked_by_hash(grouped, ["_group"], hashed, df.columns, "_rn").filter("_rn <= _most").select(*df.columns)


# ---- statistics on array columns ----

def list_statistics(df: DataFrame, values: str, ref: str | None = None) -> DataFrame:
    """Mean, population deviation, extremes and sorted forms of a list column; with `ref` also its interval index."""
    v = F.col(values)
    n = F.size(v)
    t = df.withColumn("mean", F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n)
    gap = F.aggregate(F.transform(v, lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda a, x: a + x)
    t = t.withColumn("std", F.sqrt(gap / n)).withColumn("minimum", F.array_min(v)).withColumn("maximum", F.array_max(v))
    t = t.withColumn("asc", F.sort_array(v)).withColumn("desc", F.sort_array(v, asc=False))
    return t if ref is None else t.withColumn("position", F.size(F.filter(v, lambda x: x <= F.col(ref))))
