"""Numpy helpers that run on Arrow batches inside tasks: keyed random numbers, rounding, lists around a mean."""
from __future__ import annotations

import math
from decimal import Decimal

import numpy as np

FLOATS = {53: np.float64, 24: np.float32, 11: np.float16}


def uniform(keys: np.ndarray, *salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on the row key and the salt only."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)
        for s in salt:
            z = z + np.uint64((s + 1) * 0x9E3779B97F4A7C15 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53


def between(u: np.ndarray, low, high) -> np.ndarray:
    return low + u * (high - low)


def whole(u: np.ndarray, low, high) -> np.ndarray:
    """Whole numbers low .. high-1."""
    return np.floor(low + u * (np.asarray(high) - low)).astype(np.int64)


def triangular(u: np.ndarray, left, mode, right) -> np.ndarray:
    left, mode, right = (np.asarray(v, dtype=np.float64) for v in (left, mode, right))
    width = np.maximum(right - left, 1e-300)
    split = (mode - left) / width
    up = left + np.sqrt(u * width * (mode - left))
    down = right - np.sqrt((1 - u) * width * (right - mode))
    return np.where(u < split, up, down)


def truncated_exponential(u: np.ndarray, a, b, k: float) -> np.ndarray:
    return a + np.log(1 + u * (np.exp(k * (b - a)) - 1)) / k


def round_bits(x: np.ndarray, p) -> np.ndarray:
    """Half-even to p significant bits."""
    m, e = np.frexp(x)
    p = np.broadcast_to(np.asarray(p, dtype=np.int64), x.shape)
    return np.where(np.isfinite(x) & (x != 0), np.ldexp(np.rint(np.ldexp(m, p)), e - p), x)


def floor_bits(x: np.ndarray, p, up: bool) -> np.ndarray:
    """Nearest p-bit number at or below (above, with `up`)."""
    m, e = np.frexp(x)
    p = np.broadcast_to(np.asarray(p, dtype=np.int64), x.shape)
    cut = np.ceil if up else np.floor
    return np.where(x != 0, np.ldexp(cut(np.ldexp(m, p)), e - p), x)


def bit_count(x: np.ndarray) -> np.ndarray:
    """Significant bits of a double: from its first to its last set bit."""
    m, _ = np.frexp(np.abs(x))
    n = np.ldexp(m, 53).astype(np.int64)
    low = n & -n
    return np.where(n == 0, 0, 53 - np.round(np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64))


def fixed_text(v: float) -> str:
    """Shortest text that reads back as the same double, without exponent or trailing zeros."""
    r = repr(float(v))
    if "e" in r or "E" in r:
        r = format(Decimal(r), "f")
    return r.rstrip("0").rstrip(".") if "." in r else r


def fixed_texts(x: np.ndarray) -> list[str]:
    return [fixed_text(v) for v in x.tolist()]


def digit_count(text: str) -> int:
    return len(text.replace("-", "").replace(".", "").strip("0"))


def decimal_parts(x: np.ndarray, d) -> tuple[np.ndarray, np.ndarray]:
    """(mantissa, exponent): x as a whole mantissa of d digits, half to even, times a power of ten. 0 where d < 1 or x is 0.

    What comes to less than 1e-15 is 0; what would reach 1e15 is cut instead of rounded.
    """
    x, d = np.broadcast_arrays(np.asarray(x, float), np.asarray(d, np.int64))
    size, live = np.abs(x), (np.abs(x) > 0) & (d > 0)
    lead = np.floor(np.log10(size, where=live, out=np.zeros(x.shape))).astype(np.int64)
    exponent = np.where(live, lead - d + 1, 0)
    scaled = np.where(live, size / 10.0**lead, 0.0) * 10.0 ** np.maximum(d - 1, 0)
    mantissa = np.rint(scaled)
    mantissa = np.where(mantissa * 10.0**exponent >= 1e15, np.floor(scaled), mantissa)
    mantissa = np.where(mantissa * 10.0**exponent < 1e-15, 0, mantissa).astype(np.int64)
    return np.where(x < 0, -mantissa, mantissa), exponent


def decimal_text(mantissa: int, exponent: int) -> str:
    """Fixed-point text of a whole number times a power of ten, without trailing zeros behind the point."""
    if not mantissa:
        return "0"
    if exponent >= 0:
        return str(mantissa * 10**exponent)
    digits = str(abs(mantissa)).rjust(1 - exponent, "0")
    return ("-" * (mantissa < 0) + digits[:exponent] + "." + digits[exponent:]).rstrip("0").rstrip(".")


def round_texts(x: np.ndarray, d) -> list[str]:
    """Fixed-point texts of numbers to d significant digits each."""
    mantissa, exponent = decimal_parts(x, d)
    return [decimal_text(m, e) for m, e in zip(mantissa.ravel().tolist(), exponent.ravel().tolist())]


def round_result(x: np.ndarray, digits: int) -> np.ndarray:
    """Results kept to `digits` significant decimal digits."""
    def one(v: float) -> float:
        if v == 0 or not math.isfinite(v):
            return v
        return round(v, digits - (math.floor(math.log10(abs(v))) + 1))
    return np.array([one(v) for v in x.tolist()], dtype=np.float64)


def _to_digits(x: np.ndarray, d, cut) -> np.ndarray:
    """x on the grid of d significant digits, by the given rounding of the scaled size."""
    size = np.abs(x)
    safe = np.where(size == 0, 1.0, size)
    mag = np.floor(np.log10(safe))
    shift = np.asarray(d, dtype=np.float64) - 1 - mag
    n = cut(safe / 10.0**mag * 10.0 ** (np.asarray(d, dtype=np.float64) - 1), np.sign(x))
    # wide floats keep the quotient by a power of ten on the nearest double
    wide = np.where(shift >= 0, n.astype(np.longdouble) / np.longdouble(10) ** np.maximum(shift, 0),
                    n.astype(np.longdouble) * np.longdouble(10) ** np.maximum(-shift, 0))
    out = np.where(size == 0, 0.0, wide.astype(np.float64))
    return np.sign(x) * np.where(out < 1e-15, 0.0, out)


def near_digits(x, d):
    return _to_digits(x, d, lambda n, s: np.rint(n))


def floor_digits(x, d, up: bool):
    """Nearest d-digit number at or below (above, with `up`); a number on the grid stays."""
    near = near_digits(x, d)
    outward = (lambda n, s: np.where(s > 0, np.ceil(n), np.floor(n))) if up else (lambda n, s: np.where(s > 0, np.floor(n), np.ceil(n)))
    moved = _to_digits(x, d, outward)
    return np.where((near >= x) if up else (near <= x), near, moved)


def lists_around(mean: np.ndarray, spread: np.ndarray, u: np.ndarray, precision: np.ndarray, binary: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of k numbers in [mean-spread, mean+spread] on a grid of p bits or d digits, mean as close as one common shift allows.

    Returns the numbers and a mask of the rows for which the grid has a number in the interval.
    """
    low, high = (mean - spread)[:, None], (mean + spread)[:, None]
    p = precision[:, None]
    if binary:
        near, least, most = round_bits, floor_bits(low, p, True), floor_bits(high, p, False)
    else:
        near, least, most = near_digits, floor_digits(low, p, True), floor_digits(high, p, False)
    feasible = (least <= most)[:, 0]
    base = between(u, low, high)

    def at(shift: np.ndarray) -> np.ndarray:
        y = near(base + shift[:, None], p)
        return np.where(y < low, least, np.where(y > high, most, y))

    target = u.shape[1] * mean
    lo, hi = (low - base.max(axis=1, keepdims=True))[:, 0], (high - base.min(axis=1, keepdims=True))[:, 0]
    a, b = at(lo), at(hi)
    gap_a, gap_b = np.abs(a.sum(axis=1) - target), np.abs(b.sum(axis=1) - target)
    crossing = (a.sum(axis=1) < target) & (b.sum(axis=1) > target)
    best, best_gap = np.where((gap_a <= gap_b)[:, None], a, b), np.minimum(gap_a, gap_b)
    inner, inner_gap = best.copy(), np.full(len(mean), np.inf)
    for _ in range(10):
        mid = 0.5 * (lo + hi)
        y = at(mid)
        total = y.sum(axis=1)
        gap = np.abs(total - target)
        better = gap < inner_gap
        inner, inner_gap = np.where(better[:, None], y, inner), np.where(better, gap, inner_gap)
        lo, hi = np.where(total <= target, mid, lo), np.where(total <= target, hi, mid)
    for end in (hi, lo):
        y = at(end)
        gap = np.abs(y.sum(axis=1) - target)
        better = gap <= inner_gap
        inner, inner_gap = np.where(better[:, None], y, inner), np.where(better, gap, inner_gap)
    return np.where(crossing[:, None], inner, best), feasible
