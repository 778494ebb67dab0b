"""Answer metrics as column functions, with a registry by name."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-100


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def _relative_gap(pred: Column, true: Column) -> Column:
    return F.abs(pred - true) / (F.abs(true) + F.abs(pred) + F.lit(EPS))


def smape(pred: Column, true: Column) -> Column:
    """1 - |p-t| / (|t|+|p|); not-a-number counts 0."""
    value = F.lit(1.0) - _relative_gap(pred, true)
    return F.when(F.isnan(value), 0.0).otherwise(value)


def log_smape(pred: Column, true: Column, digits: int = 15) -> Column:
    """Matching digits as a share of `digits`, at most 1; a prediction that is not finite counts 0."""
    value = F.least(F.lit(1.0), F.log10(_relative_gap(pred, true) + F.lit(EPS)) / F.lit(-float(digits)))
    return F.when(_finite(pred) & _finite(true), value).otherwise(0.0)


def log_smape_32(pred: Column, true: Column) -> Column:
    return log_smape(pred, true, 6)


def exact_number(pred: Column, true: Column, digits: int = 14) -> Column:
    """Whether the gap is below one unit of the last kept decimal."""
    decimals = F.least(F.greatest(F.lit(float(digits)) - F.ceil(F.log10(F.abs(true) + F.lit(EPS))), F.lit(0.0)), F.lit(float(digits)))
    return F.abs(pred - true) < F.pow(F.lit(10.0), -decimals)


def sig_bits(pred: Column, true: Column, max_bits: int = 53) -> Column:
    """Correct leading bits as a share of max_bits."""
    zeros = (F.abs(true) < EPS) & (F.abs(pred) < EPS)
    gap = F.abs((pred - true) / (F.abs(true) + F.lit(EPS)))
    bits = F.least(F.greatest(-F.log2(gap), F.lit(0.0)), F.lit(float(max_bits))) / F.lit(float(max_bits))
    return F.when(zeros | (pred == true), 1.0).when(gap > EPS, F.when(F.isnan(bits), 0.0).otherwise(bits)).otherwise(0.0)


def token_equality(pred: Column, true: Column) -> Column:
    """Share of equal tokens in two arrays of one length."""
    same = F.zip_with(pred, true, lambda a, b: a.eqNullSafe(b).cast("int"))
    hits = F.aggregate(same, F.lit(0), lambda total, v: total + v)
    return hits / F.size(true)


def class_acc(accuracy: Column, classes: float = 2.8) -> Column:
    """Accuracy rescaled so that guessing among `classes` gives 0."""
    return F.greatest(F.lit(0.0), (F.lit(classes) * accuracy - 1) / F.lit(classes - 1))


def scaled_ppl(ppl: Column, min_ppl: float = 40.0, scale: float = 100.0) -> Column:
    """Perplexity mapped to [0, 1]; 1 at or below min_ppl."""
    return F.least(F.lit(1.0), F.exp((F.lit(min_ppl) - ppl) / F.lit(scale)))


def generalized_mean(accuracy: Column, p: float = 1.0, eps: float = 0.01) -> Column:
    """Power mean over the rows of a group; p = 0 is the geometric mean."""
    floor = F.greatest(accuracy, F.lit(eps))
    if p == 0:
        return F.exp(F.avg(F.log(floor)))
    return F.pow(F.avg(F.pow(floor, F.lit(float(p)))), F.lit(1.0 / p))


@dataclass(frozen=True)
class Metric:
    """A row metric of (prediction, truth), and the value above which a row counts as correct."""

    score: Callable[..., Column]
    threshold: float
    inclusive: bool = False

    def correct(self, score: Column) -> Column:
        return score >= self.threshold if self.inclusive else score > self.threshold


METRICS: dict[str, Metric] = {
    "sMAPE": Metric(smape, 0.95),
    "logSMAPE": Metric(log_smape, 0.5),
    "logSMAPE_32": Metric(log_smape_32, 0.5),
    "exact_number_acc": Metric(lambda p, t: exact_number(p, t).cast("double"), 0.5),
    "sig_bits_acc": Metric(sig_bits, 0.95),
    "token_equality": Metric(token_equality, 1.0, inclusive=True),
}


def register_metric(name: str, score: Callable[..., Column], threshold: float, inclusive: bool = False) -> None:
    """Makes a metric of the user's available by name."""
    METRICS[name] = Metric(score, threshold, inclusive)


def metric(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"unknown metric: {name}")
    return METRICS[name]
