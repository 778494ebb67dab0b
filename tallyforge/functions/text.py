"""Numbers as text: shape, rounding, extraction from running text, replacement by tokens."""
from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tallyforge.constants import NUM, NUMBER, UNSIGNED_NUMBER, magnitude_edges


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def count_at_or_below(edges: Column, x: Column, n_edges: int) -> Column:
    """How many of the ascending edges are at or below x, by halving steps."""
    bits = max(1, n_edges.bit_length())
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= x, at + step).otherwise(at)
    )


# ---- shape ----

def sig_digits(text: Column | str) -> Column:
    """Digits left after the sign, the point and zeros at both ends are gone."""
    return F.length(F.btrim(F.translate(_col(text), "-.", ""), F.lit("0")))


def place_point(digits: Column, point: Column) -> Column:
    """Fixed-point text of a digit string whose decimal point sits after `point` digits."""
    n = F.length(digits)
    return (
        F.when(n == 0, F.lit("0"))
        .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
        .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
    )


def _split_text(text: Column) -> Column:
    """Digits and point position of an unsigned decimal text, with or without exponent."""
    mantissa = F.substring_index(text, "E", 1)
    exponent = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
    whole = F.substring_index(mantissa, ".", 1)
    raw = F.translate(mantissa, ".", "")
    lead = F.length(raw) - F.length(F.ltrim(raw, F.lit("0")))
    return F.struct(
        F.btrim(raw, F.lit("0")).alias("digits"), (F.length(whole) + exponent - lead).alias("point"),
    )


def shortest_digits(size: Column) -> Column:
    """Digits and point position of the shortest text that reads back as the same positive double."""
    def shortest(text: Column) -> Column:
        cand = [F.upper(F.format_string(f"%.{k}e", size)) for k in (14, 15)]
        long = F.length(F.translate(F.substring_index(text, "E", 1), ".", "")) > 15
        pick = F.when(cand[0].cast("double") == size, cand[0]).when(cand[1].cast("double") == size, cand[1]).otherwise(text)
        return F.when(long, pick).otherwise(text)

    return let(let(size.cast("string"), shortest), _split_text)


def fixed_point(x: Column | str) -> Column:
    """Shortest text that reads back as the same double, without exponent; null beyond 52 decimals."""
    x = _col(x).cast("double")

    def write(parts: Column) -> Column:
        digits, point = parts["digits"], parts["point"]
        sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
        return F.when(F.length(digits) - point <= 52, F.concat(sign, place_point(digits, point)))

    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(finite, let(shortest_digits(F.abs(x)), write))


def round_sig(text: Column | str, d: Column | int) -> Column:
    """Decimal text rounded half-even to d significant digits (d up to 15); 0 below 1e-15, cut instead of reaching 1e15."""
    text = _col(text)
    d = F.lit(d) if isinstance(d, int) else d
    x = text.try_cast("double")
    size = F.abs(x)

    def at_magnitude(mag: Column) -> Column:
        scale = F.pow(F.lit(10.0), d - 1)
        unit = F.pow(F.lit(10.0), mag)
        scaled = size / unit
        whole = F.rint(scaled * scale)
        whole = F.when(whole / scale * unit >= 1e15, F.floor(scaled * scale).cast("double")).otherwise(whole)

        def write(n: Column) -> Column:
            result = n / scale * unit
            raw = n.cast("decimal(20,0)").cast("string")
            body = place_point(F.rtrim(raw, F.lit("0")), F.length(raw) - (d - 1) + mag)
            return F.when(result < 1e-15, F.lit("0")).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), body))

        return let(whole, write)

    rounded = let(F.floor(F.log10(size)).cast("int"), at_magnitude)
    return F.when(x.isNull() | (x == 0) | (d <= 0), F.lit("0")).otherwise(rounded)


def binary_exponent(size: Column) -> Column:
    """Exponent e of a positive double with 2^e <= size < 2^(e+1)."""
    def fix(e: Column) -> Column:
        m = size / F.pow(F.lit(2.0), e)
        return F.when(m >= 2.0, e + 1).when(m < 1.0, e - 1).otherwise(e)

    return let(F.floor(F.log2(size)).cast("int"), fix)


def round_bits(x: Column | str, p: Column | int) -> Column:
    """Double rounded half-even to p significant bits. Scaling by powers of two is exact."""
    x = _col(x).cast("double")
    p = F.lit(p) if isinstance(p, int) else p

    def at(e: Column) -> Column:
        up = F.pow(F.lit(2.0), p - 1 - e)
        return F.rint(x * up) / up

    return F.when((x == 0) | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x).otherwise(let(binary_exponent(F.abs(x)), at))


def base2_text(x: Column | str) -> Column:
    """Exact base-2 text of a double: trailing zeros of the fraction dropped, '0.0' for zero."""
    def write(v: Column) -> Column:
        size = F.abs(v)

        def at(e: Column) -> Column:
            whole = (size * F.pow(F.lit(2.0), F.lit(52) - e)).cast("bigint")
            return F.concat(F.when(v < 0, "-").otherwise(""), place_point(F.rtrim(F.bin(whole), F.lit("0")), e + 1))

        return F.when(v == 0, F.lit("0.0")).otherwise(let(binary_exponent(size), at))

    return let(_col(x).cast("double"), write)


def base_text(n: Column | str, base: int) -> Column:
    """Text of a non-negative whole number in a base from 2 to 36."""
    return F.conv(_col(n).cast("bigint").cast("string"), 10, base)


def base_value(text: Column | str, base: int) -> Column:
    """Double of a base-b text with optional sign and fraction."""
    text = F.upper(_col(text))
    body = F.ltrim(text, F.lit("-"))
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[:base]

    def fold(part: Column) -> Column:
        marks = F.filter(F.split(part, ""), lambda c: c != "")
        return F.aggregate(marks, F.lit(0.0), lambda acc, c: acc * base + (F.instr(F.lit(digits), c) - 1).cast("double"))

    whole = fold(F.substring_index(body, ".", 1))
    fraction = F.when(F.contains(body, F.lit(".")), F.rtrim(F.substring_index(body, ".", -1), F.lit("0"))).otherwise("")
    value = whole + fold(fraction) / F.pow(F.lit(float(base)), F.length(fraction))
    return F.when(F.startswith(text, F.lit("-")), -value).otherwise(value)


def quantize_low(text: Column | str, k: int) -> Column:
    """Base text with its k lowest digits set to zero; leading zeros dropped."""
    text = _col(text)
    kept = F.substr(text, F.lit(1), F.greatest(F.length(text) - k, F.lit(0)))
    cut = F.ltrim(F.concat(kept, F.lit("0" * k)), F.lit("0"))
    return F.when(cut == "", "0").otherwise(cut)


def lowest_set_digit(text: Column | str) -> Column:
    """Position from the right of the lowest non-zero digit; -1 when there is none."""
    body = F.ltrim(_col(text), F.lit("0"))
    return F.when(body == "", -1).otherwise(F.length(body) - F.length(F.rtrim(body, F.lit("0"))))


# ---- numbers in running text ----

def extract_numbers(text: Column | str, negative: bool = True) -> Column:
    """All numbers in a text, in order."""
    found = F.regexp_extract_all(_col(text), F.lit(NUMBER if negative else UNSIGNED_NUMBER), F.lit(0))
    return F.transform(found, lambda s: s.cast("double"))


def magnitude_bin(x: Column | str, edges: list[float] | None = None) -> Column:
    """0-based magnitude class: how many edges are at or below the number."""
    edges = magnitude_edges() if edges is None else edges
    return count_at_or_below(F.array(*[F.lit(e) for e in edges]), _col(x), len(edges))


def replace_numbers(text: Column | str, negative: bool = True, magnitude: bool = False) -> Column:
    """Struct of the text with every number replaced by its token, and the numbers in order."""
    text = _col(text)
    pattern = NUMBER if negative else UNSIGNED_NUMBER
    numbers = extract_numbers(text, negative)
    if not magnitude:
        return F.struct(F.regexp_replace(text, pattern, F.lit(NUM)).alias("text"), numbers.alias("numbers"))
    parts = F.split(text, pattern, -1)
    tokens = F.transform(numbers, lambda x: F.concat(F.lit("<|num_"), magnitude_bin(x).cast("string"), F.lit("|>")))
    joined = F.array_join(F.zip_with(parts, tokens, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")
    return F.struct(joined.alias("text"), numbers.alias("numbers"))


def split_digits(text: str) -> list[float]:
    """A decimal text as one number when a double holds it, else in parts of at most 15 digits, each at its own magnitude."""
    if Decimal(text) == Decimal(float(text)):
        return [float(text)]
    sign = "-" if text.startswith("-") else ""
    whole, _, fraction = text.lstrip("+-").partition(".")
    fraction = fraction.rstrip("0")
    digits, parts = whole + fraction, []
    while digits.strip("0"):
        digits = digits.lstrip("0")
        part, digits = digits[:15], digits[15:]
        parts.append(float(f"{sign}{part}e{len(digits) - len(fraction)}"))
    return parts or [0.0]


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def _split_all(found: pd.Series) -> pd.Series:
    return found.map(lambda texts: None if texts is None else [split_digits(t) for t in texts])


def split_large_numbers(text: Column | str) -> Column:
    """Numbers of a text; those with more than 15 digits come as several exact parts.

    Only texts that hold a run of more than 15 digits are sent to Python.
    """
    text = _col(text)
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    long = F.exists(found, lambda s: F.length(F.translate(s, "-.", "")) > 15)
    return F.coalesce(F.flatten(_split_all(F.when(long, found))), extract_numbers(text))
