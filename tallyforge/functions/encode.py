"""Number encodings: IEEE bits, decimal digits, Fourier features, scaled values, vocabulary sizes."""
from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.metrics import log_smape
from tallyforge.functions.text import _col, binary_exponent, let, round_bits

# Decimal digits of the exponent and the mantissa, and the bias of the exponent.
EXPONENT_DIGITS, MANTISSA_DIGITS, EXPONENT_BIAS = 3, 17, 500
INF = float("inf")


def _pow2(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def to_width(x: Column, width: int) -> Column:
    """The double nearest to x among the numbers of a narrower float type."""
    if width == 64:
        return x
    if width == 32:
        return x.cast("float").cast("double")
    small = F.rint(x * 2.0**24) / 2.0**24
    normal = round_bits(x, 11)
    return F.when(F.abs(x) < 2.0**-14, small).when(F.abs(normal) > 65504, F.signum(x) * F.lit(INF)).otherwise(normal)


def _java(kind: str, method: str, x: Column, empty) -> Column:
    """What a static method of java.lang returns for a number; null for null."""
    return F.when(x.isNotNull(), F.reflect(F.lit(f"java.lang.{kind}"), F.lit(method), F.coalesce(x, F.lit(empty))))


def raw_bits(x: Column | str) -> Column:
    """The 64 bits of a double as a long: subnormal numbers, both zeros and infinities as they are, one kind of NaN."""
    return _java("Double", "doubleToLongBits", _col(x).cast("double"), 0.0).cast("bigint")


def bits_double(bits: Column) -> Column:
    """The double behind 64 bits."""
    return _java("Double", "longBitsToDouble", bits, 0).cast("double")


def _bit_text(whole: Column, width: int) -> Column:
    return F.right(F.lpad(F.bin(whole), 64, "0"), F.lit(width))


def number_bits(x: Column | str, width: int = 64, reciprocal: bool = False) -> Column:
    """IEEE bits of a number as text, sign first; with `reciprocal` followed by those of 1/x."""
    x = _col(x).cast("double")
    if reciprocal:
        inverse = F.when(x == 0, F.when(raw_bits(x) < 0, F.lit(-INF)).otherwise(F.lit(INF))).otherwise(F.lit(1.0) / F.when(x != 0, x))
        return F.concat(number_bits(x, width), number_bits(inverse, width))
    if width == 64:
        return _bit_text(raw_bits(x), 64)
    if width == 32:
        single = F.reflect(F.lit("java.lang.Float"), F.lit("floatToIntBits"), F.coalesce(x, F.lit(0.0)).cast("float"))
        return _bit_text(F.when(x.isNotNull(), single).cast("int").cast("bigint"), 32)

    def write(v: Column) -> Column:
        b = raw_bits(v)
        e, m = F.shiftrightunsigned(b, 52).bitwiseAND(F.lit(2047)), b.bitwiseAND(F.lit((1 << 52) - 1))
        normal = (e - 1008) * 1024 + F.shiftright(m, 42)
        # the smallest numbers are multiples of 2 ** -24
        small = F.when(e < 1009, F.abs(v) * 2.0**24).otherwise(0.0).cast("bigint")
        size = F.when(e == 2047, F.lit(31 << 10) + F.when(m != 0, 512).otherwise(0)).when(e < 1009, small).otherwise(normal)
        return _bit_text(F.shiftrightunsigned(b, 63) * 32768 + size, 16)

    return let(to_width(x, width), write)


def bits_value(bits: Column | str, width: int = 64) -> Column:
    """The number behind a bit text."""
    bits = _col(bits)
    whole = F.conv(bits, 2, -10 if width == 64 else 10).cast("bigint")
    if width == 64:
        return bits_double(whole)
    if width == 32:
        signed = F.when(whole >= 1 << 31, whole - (1 << 32)).otherwise(whole).cast("int")
        return _java("Float", "intBitsToFloat", signed, 0).cast("float").cast("double")

    def read(b: Column) -> Column:
        e, m = F.shiftright(b, 10).bitwiseAND(F.lit(31)), b.bitwiseAND(F.lit(1023)).cast("double")
        size = F.when(e == 31, F.when(m == 0, INF).otherwise(float("nan"))).when(e == 0, m * 2.0**-24).otherwise((m + 1024) * _pow2(e - 25))
        return F.when(b >= 1 << 15, -size).otherwise(size)

    return let(whole, read)


def number_digits10(x: Column | str) -> Column:
    """Decimal digits of a number as text: sign (1 for >= 0), 3 biased exponent digits, 17 mantissa digits."""
    x = _col(x).cast("double")

    def write(e: Column) -> Column:
        mantissa = F.when(x == 0, 0.0).otherwise(F.abs(x) / F.pow(F.lit(10.0), e))
        whole = F.rint(mantissa * 10.0 ** (MANTISSA_DIGITS - 1)).cast("bigint").cast("string")
        power = F.lpad((e + EXPONENT_BIAS).cast("string"), EXPONENT_DIGITS, "0")
        return F.concat(F.when(x >= 0, "1").otherwise("0"), power, F.right(F.lpad(whole, MANTISSA_DIGITS + 2, "0"), F.lit(MANTISSA_DIGITS)))

    return let(F.when(x == 0, 0).otherwise(F.floor(F.log10(F.abs(F.when(x == 0, 1.0).otherwise(x)))).cast("int")), write)


def digits10_value(digits: Column | str) -> Column:
    """The number behind a decimal digit text."""
    digits = _col(digits)
    power = F.substr(digits, F.lit(2), F.lit(EXPONENT_DIGITS)).cast("int") - EXPONENT_BIAS
    mantissa = F.substr(digits, F.lit(2 + EXPONENT_DIGITS)).cast("double") / 10.0 ** (MANTISSA_DIGITS - 1)
    size = F.when(mantissa == 0, 0.0).otherwise(mantissa * F.pow(F.lit(10.0), power))
    return F.when(F.startswith(digits, F.lit("1")), size).otherwise(-size)


def _largest_power(base: int, limit: int) -> int:
    """Largest exponent whose power of the base does not exceed the limit."""
    e = int(math.log(limit, base)) + 1
    while base**e > limit:
        e -= 1
    return e


def fourier_periods(int_digits: int = 17, frac_digits: int = 32, bases: tuple[int, ...] = (10,)) -> list[float]:
    """Ascending periods: the powers b ** e of each base b.

    e runs from one above the smallest power that is at least 10 ** -frac_digits to the largest power of at most `int_digits` + 1
    digits. Powers are exact until they become doubles, so bases that share a period give it once.
    """
    ranges = {b: range(1 - _largest_power(b, 10**frac_digits), _largest_power(b, 10 ** (int_digits + 1) - 1) + 1) for b in bases}
    return sorted({float(Fraction(b) ** e) for b, exponents in ranges.items() for e in exponents})


def bit_profile(df: DataFrame, bits: str, source: list[str], width: int = 64) -> DataFrame:
    """Share of ones at every place (from 1) of a column of bit texts, and the number of different texts, by source."""
    # different texts first, so that a group of the wide sums is a source and not a text
    texts = df.groupBy(*source, F.col(bits).alias("_bits")).agg(F.count("*").alias("_n"))
    rows = F.sum(F.when(F.col("_bits").isNotNull(), F.col("_n")))
    ones = [F.sum(F.when(F.substring("_bits", i, 1) == "1", F.col("_n")).when(F.col("_bits").isNotNull(), 0)) for i in range(1, width + 1)]
    g = texts.groupBy(*source).agg(F.array(*[n.cast("double") / rows for n in ones]).alias("_ones"), F.count("_bits").alias("n_distinct"))
    return g.select(*source, F.posexplode("_ones").alias("_at", "share"), "n_distinct").select(*source, (F.col("_at") + 1).alias("place"), "share", "n_distinct")


def number_fourier(x: Column | str, periods: list[float]) -> Column:
    """Cosine and sine of the number for every period, in turn; zeros for the number 0."""
    x = _col(x).cast("double")
    waves = [f(x * F.lit(2.0 * math.pi / p)) for p in periods for f in (F.cos, F.sin)]
    return F.when(x != 0, F.array(*waves)).otherwise(F.array(*[F.lit(0.0)] * len(waves)))


def number_logscale(x: Column | str, scaling: str = "log", max_num: float = 1e15, min_num: float = 1e-14) -> Column:
    """Number clamped to +-max_num and scaled to +-5, linearly or by its logarithm."""
    x = F.greatest(F.least(_col(x).cast("double"), F.lit(max_num)), F.lit(-max_num))
    if scaling == "linear":
        return x * F.lit(5.0 / max_num)
    factor = 2.5 / math.log10(max_num)
    return F.when(F.abs(x) >= min_num, (F.lit(factor) * F.log10(F.abs(x) + min_num) + 2.5) * F.signum(x)).otherwise(0.0)


def logscale_value(enc: Column | str, scaling: str = "log", max_num: float = 1e15, min_num: float = 1e-14) -> Column:
    """The number behind a scaled value."""
    enc = _col(enc).cast("double")
    if scaling == "linear":
        return F.greatest(F.least(enc / F.lit(5.0 / max_num), F.lit(max_num)), F.lit(-max_num))
    factor = 2.5 / math.log10(max_num)
    floor = factor * math.log10(2 * min_num) + 2.5
    return F.when(F.abs(enc) >= floor, F.signum(enc) * (F.pow(F.lit(10.0), (F.abs(enc) - 2.5) / F.lit(factor)) - min_num)).otherwise(0.0)


def _digest(key: Column, seed: int, parts: int, what: str = "") -> Column:
    """32 hexadecimal digits for each of `parts` keyed draws."""
    return F.concat(*[F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(f":{what}{i}"))) for i in range(parts)])


def flip_mask(key: Column | str, share: float, seed: int = 42) -> Column:
    """64 keyed draws as bit text: place j is 1 where the j-th four digits of eight md5 sums lie below the share of 65536."""
    limit = f"{min(int(round(share * 65536)), 65535):04x}"
    # three passes over the digits, whatever the number of places: a blank after every four, then 1 for those below, 0 for the rest
    spaced = F.regexp_replace(_digest(_col(key), seed, 8), "(....)", "$1 ")
    marked = F.regexp_replace(spaced, f"(?:{_below(limit)}) ", "1") if int(limit, 16) else spaced
    return F.coalesce(F.regexp_replace(marked, "[0-9a-f]{4} ", "0"), F.lit("0" * 64))


def _below(limit: str) -> str:
    """Pattern of the lower-case hexadecimal texts of the limit's length that stand before it."""
    digits = "0123456789abcdef"
    return "|".join(f"{limit[:i]}[{digits[:digits.index(c)]}][0-9a-f]{{{len(limit) - i - 1}}}" for i, c in enumerate(limit) if c != "0")


def _uniform(key: Column, seed: int, what: str) -> Column:
    """Keyed draw from -1 to 1."""
    return F.conv(F.substr(_digest(key, seed, 1, what), F.lit(1), F.lit(13)), 16, 10).cast("double") / float(1 << 51) - 1


def flip_share(noise: float, bernoulli: float) -> float:
    """How often a symbol of size 1 changes its sign: by white noise above 1, or by being replaced with a draw from -1 to 1."""
    white = (noise - 1) / (2 * noise) if noise > 1 else 0.0
    return bernoulli / 2 + (1 - bernoulli) * white


def roundtrip(x: Column | str, encoding: str, noise: float = 0.0, seed: int = 42, key: Column | None = None, bottleneck_bits: int = 8,
              bernoulli: float = 0.0, clamp: float | None = None) -> Column:
    """decode(encode(x)) with keyed noise on the encoding: white noise of that size, then a `bernoulli` share of values redrawn.

    `bits` passes 64 symbols of -1 or 1 that are read by their sign, so noise is a mask of flipped bits; `digits10` passes digits,
    which noise does not reach. `log` and `linear` pass a float of `bottleneck_bits` significant bits, as a model's narrow
    layer would, held within `clamp` after the white noise.
    """
    x = _col(x).cast("double")
    key = raw_bits(x).cast("string") if key is None else key
    if encoding == "bits":
        share = flip_share(noise, bernoulli)
        if share <= 0:
            return bits_value(number_bits(x))
        flipped = F.conv(flip_mask(key, share, seed), 2, -10).cast("bigint")
        # null only where x is, so the mask is not drawn again to find out
        whole = F.coalesce(raw_bits(x), F.lit(0).cast("bigint")).bitwiseXOR(flipped)
        return F.when(x.isNotNull(), F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), whole).cast("double"))
    if encoding == "digits10":
        return let(number_digits10(x), digits10_value)
    if encoding not in ("log", "linear"):
        raise ValueError(f"unknown encoding: {encoding}")
    enc = round_bits(number_logscale(x, encoding).cast("float").cast("double"), bottleneck_bits)
    if noise > 0:
        enc = enc + _uniform(key, seed, "white") * noise
    if clamp is not None:
        enc = F.least(F.greatest(enc, F.lit(-float(clamp))), F.lit(float(clamp)))
    if bernoulli > 0:
        enc = F.when((_uniform(key, seed, "which") + 1) / 2 < bernoulli, _uniform(key, seed, "drawn")).otherwise(enc)
    return logscale_value(round_bits(enc, bottleneck_bits), encoding)


def roundtrip_report(df: DataFrame, col: str, encoding: str, noise: float = 0.0, seed: int = 42, rel_tol: float = 1e-14, abs_tol: float = 1e-14,
                     bernoulli: float = 0.0, grace: float = 1, clamp: float | None = None, key: str | None = None) -> DataFrame:
    """Per decimal exponent of the number: rows, share read back within tolerance (times `grace`), mean matching digits.

    Noise is keyed by the column `key`, or by the number itself.
    """
    t = df.select(F.col(col).cast("double").alias("x"), (F.col(key) if key else raw_bits(F.col(col))).cast("string").alias("key"))
    t = t.withColumn("back", roundtrip("x", encoding, noise, seed, F.col("key"), bernoulli=bernoulli, clamp=clamp))
    gap = F.abs(F.col("x") - F.col("back"))
    near = gap <= F.greatest(F.lit(rel_tol * grace) * F.greatest(F.abs(F.col("x")), F.abs(F.col("back"))), F.lit(abs_tol * grace))
    exponent = F.when(F.col("x") != 0, F.floor(F.log10(F.abs("x"))).cast("int"))
    return t.groupBy(exponent.alias("exponent")).agg(
        F.count("*").alias("n"), F.avg(F.coalesce(near & ~F.isnan("back"), F.lit(False)).cast("double")).alias("accuracy"),
        F.avg(F.when(~F.isnan("back"), log_smape(F.col("back"), F.col("x")))).alias("mean_log_smape"),
    )


def roundtrip_values(spark, max_value: float = 1e14, tiny: float = 1e-14, per_exponent: int = 1000, seed: int = 42) -> DataFrame:
    """Test numbers: hashed mantissas in [1, 10) of both signs for every exponent, plus fixed edge values."""
    low, high = math.ceil(math.log10(tiny)), int(math.log10(max_value))
    ids = spark.range((high - low) * 2 * per_exponent)
    e = (F.col("id") / (2 * per_exponent)).cast("int") + low
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 50)).cast("double") / float(1 << 50)
    sign = F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)
    edges = [-max_value, -5.0, -1.000001, -0.999999999, -tiny, 0.0, tiny, 0.999999999, 1.0, 1.000001, math.pi, max_value, 1e-7]
    fixed = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in edges])).alias("x"))
    return ids.select((sign * (u * 9 + 1) * F.pow(F.lit(10.0), e)).alias("x")).unionAll(fixed)


def number_tokens(number_text: Column | str) -> Column:
    """Tokens of one number under four vocabularies: single digits, groups of up to three, one token, one magnitude token."""
    t = _col(number_text)
    return F.struct(
        F.length(F.regexp_replace(t, "[^0-9]", "")).alias("single_digit"),
        F.size(F.regexp_extract_all(t, F.lit("[1-9][0-9]{0,2}|0"), F.lit(0))).alias("three_digit"),
        F.lit(1).alias("number_token"), F.lit(1).alias("magnitude_token"),
    )
