"""Running totals and ranks that never put a whole group into one task.

A group is cut into slices that follow the order. Slice totals are small and are summed first;
rows then only need the running total inside their own slice plus the total of earlier slices.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.encode import bits_double, raw_bits
from tallyforge.functions.text import count_at_or_below
from tallyforge.session import bucket_count, materialized


def hash_slice(hashed: Column, n: int) -> Column:
    """Slice number of a 64-bit hash; grows with the signed hash."""
    share = hashed.cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return F.least(F.floor(share * F.lit(float(n))), F.lit(n - 1)).cast("int")


def quantile_slices(df: DataFrame, order: str, n: int | None = None) -> DataFrame:
    """Adds `_slice`: the number of the n-quantiles of `order` at or below the row's value."""
    n = n or bucket_count(df)
    cuts = [i / n for i in range(1, n)]
    edges = df.select(F.percentile_approx(order, cuts, max(10_000, 20 * n))).scalar()
    out = df.withColumn("_edges", edges)
    return out.withColumn("_slice", count_at_or_below(F.col("_edges"), F.col(order), n - 1)).drop("_edges")


def running_totals(
    df: DataFrame, keys: list[str], order: list[str | Column], totals: dict[str, Column | str], slice_col: str = "_slice",
) -> DataFrame:
    """Adds inclusive running totals per group; `slice_col` must not decrease along the order."""
    named = {name: (F.expr(c) if isinstance(c, str) else c) for name, c in totals.items()}
    base = df.select("*", *[c.alias(f"_v_{n}") for n, c in named.items()])
    sums = base.groupBy(*keys, slice_col).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in named])
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(slice_col).alias("_ks"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in named],
    )
    inside = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in named])
    match = F.col(slice_col) == F.col("_ks")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(offsets, match)
    keep = [c for c in df.columns if c != slice_col]
    return joined.select(*keep, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in named])


def ranked(df: DataFrame, keys: list[str], order: str, name: str = "rn", n: int | None = None, ties: list[str] = ()) -> DataFrame:
    """Adds the 1-based rank per group along a numeric order column."""
    sliced = quantile_slices(df, order, n)
    return running_totals(sliced, keys, [order, *ties], {name: F.lit(1).cast("bigint")})


def ranked_by_hash(df: DataFrame, keys: list[str], hashed: Column, ties: list[str], name: str = "rn", n: int | None = None) -> DataFrame:
    """Adds the 1-based rank per group along a hash; ties are broken by the given columns."""
    n = n or bucket_count(df)
    sliced = df.withColumn("_h", hashed).withColumn("_slice", hash_slice(F.col("_h"), n))
    return running_totals(sliced, keys, ["_h", *ties], {name: F.lit(1).cast("bigint")}).drop("_h")


# ---- exact order statistics ----

DIGIT = 16
_TOP = -(1 << 63)


def _ordered(x: Column) -> Column:
    """A long whose unsigned order is that of the doubles; zeros of both signs are one, NaN is the largest."""
    b = raw_bits(x + 0.0)
    return F.when(b < 0, b.bitwiseXOR(F.lit(-1).cast("bigint"))).otherwise(b.bitwiseXOR(F.lit(_TOP).cast("bigint")))


def _unordered(e: Column) -> Column:
    b = F.when(e < 0, e.bitwiseXOR(F.lit(_TOP).cast("bigint"))).otherwise(e.bitwiseXOR(F.lit(-1).cast("bigint")))
    return bits_double(b)


def quantiles(counts: DataFrame, col: str, keys: list[str], shares: list[float], n: str = "n") -> DataFrame:
    """(keys, q0, q1, ...): exact quantiles per group, interpolated between neighbours, of a table of values and their counts.

    Found digit by digit: the values' bits are ordered like the values, so counts by their first 16 bits tell which of them hold
    the wanted ranks, counts by the next 16 bits go on inside those only, and after four rounds the values are known. A round
    moves counts, never a group, and nothing is sorted but at most 65 536 digits.
    """
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = materialized(counts.where(F.col(col).isNotNull()).select(group.alias("g"), _ordered(F.col(col).cast("double")).alias("e"), F.col(n).cast("bigint").alias("n")), "value-counts")
    place = lambda p: F.lit(p) * (F.col("size") - 1)
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("high"), (F.ceil if h else F.floor)(place(p)).alias("rank")) for i, p in enumerate(shares) for h in (0, 1)])
    wanted = rows.groupBy("g").agg(F.sum("n").alias("size")).select("g", "size", F.inline(ranks)).withColumn("prefix", F.lit(0).cast("bigint"))
    for level in range(64 // DIGIT):
        prefix = F.shiftrightunsigned("e", 64 - DIGIT * level) if level else F.lit(0).cast("bigint")
        digit = F.shiftrightunsigned("e", 64 - DIGIT * (level + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1))
        parts = rows.select("g", prefix.alias("prefix"), digit.alias("digit"), "n")
        if level:
            parts = parts.join(wanted.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi")
        sums = parts.groupBy("g", "prefix", "digit").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("g", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("after", F.sum("n").over(upto))
        met = wanted.join(sums, ["g", "prefix"]).where((F.col("rank") < F.col("after")) & (F.col("rank") >= F.col("after") - F.col("n")))
        wanted = met.select("g", "size", "i", "high", (F.col("rank") - (F.col("after") - F.col("n"))).alias("rank"), F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit")).alias("prefix"))
        if level < 64 // DIGIT - 1:
            wanted = materialized(wanted, "wanted-ranks")  # a few rows for each group
    found = wanted.withColumn("x", _unordered(F.col("prefix")))
    value = lambda i, h: F.max(F.when((F.col("i") == i) & (F.col("high") == h), F.col("x")))
    pairs = found.groupBy("g").agg(F.first("size").alias("size"), *[value(i, h).alias(f"_{i}_{h}") for i in range(len(shares)) for h in (0, 1)])

    def between(i: int, p: float) -> Column:
        low, high, at = F.col(f"_{i}_0"), F.col(f"_{i}_1"), place(p)
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return pairs.select(*[F.col("g")[k].alias(k) for k in keys], *[between(i, p).alias(f"q{i}") for i, p in enumerate(shares)])
