"""Metrics as aggregate columns, so that all metrics of all groups come from one pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """The next whole number up from x - 0.5, which for negative halves isn't what `round` gives."""
    return F.floor(x + 0.5).cast("double")


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def r2(y: Column, p: Column) -> Column:
    """1 - SSres / SStot, below zero for predictions worse than the mean; an error if the truth is constant."""
    spread = F.var_pop(y) * F.count(y)
    return F.when(spread > 0, 1 - F.sum((y - p) * (y - p)) / spread).otherwise(F.raise_error(F.lit("r2 needs a truth that varies")).cast("double"))


def _share(condition: Column) -> Column:
    """The share of rows that meet it, of those for which it can be told: nulls are left out, as by means."""
    return F.avg(condition.cast("int"))


def rounded_accuracy(y: Column, p: Column) -> Column:
    return _share(half_up(p) == y)


def within_one(y: Column, p: Column) -> Column:
    return _share(F.abs(half_up(p) - y) <= 1)


def underprediction_rate(y: Column, p: Column) -> Column:
    return _share(half_up(p) < y)


def mean_excess(y: Column, p: Column) -> Column:
    return F.avg(half_up(p) - y)


def pinball(y: Column, p: Column, q: float) -> Column:
    return F.avg(F.greatest(F.lit(q) * (y - p), F.lit(q - 1.0) * (y - p)))


def interval_coverage(y: Column, lower: Column, upper: Column) -> Column:
    return _share((lower <= y) & (y <= upper))


def mean_interval_width(lower: Column, upper: Column) -> Column:
    return F.avg(upper - lower)


def accuracy(y: Column, p: Column) -> Column:
    return _share(y == p)


def confusion(y: Column, p: Column, positive: Column) -> dict[str, Column]:
    """tp, fp, fn and tn as long columns."""
    t, s = y == positive, p == positive
    return {"tp": F.count_if(t & s), "fp": F.count_if(~t & s), "fn": F.count_if(t & ~s), "tn": F.count_if(~t & ~s)}


def _ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)


def precision(c: dict[str, Column]) -> Column:
    return _ratio(c["tp"], c["tp"] + c["fp"])


def recall(c: dict[str, Column]) -> Column:
    return _ratio(c["tp"], c["tp"] + c["fn"])


def f1(c: dict[str, Column]) -> Column:
    return _ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"])


def balanced_accuracy(c: dict[str, Column]) -> Column:
    """The mean of both classes' recalls; an error where a class is absent."""
    positives, negatives = c["tp"] + c["fn"], c["tn"] + c["fp"]
    mean = (c["tp"].cast("double") / positives + c["tn"].cast("double") / negatives) / 2
    absent = F.raise_error(F.lit("balanced accuracy needs both classes")).cast("double")
    return F.when((positives > 0) & (negatives > 0), mean).otherwise(absent)


def mcc(c: dict[str, Column]) -> Column:
    """Matthews' coefficient, 0 on an empty denominator. Counts become doubles before they are multiplied."""
    tp, fp, fn, tn = (c[k].cast("double") for k in ("tp", "fp", "fn", "tn"))
    denominator = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(denominator == 0, 0.0).otherwise((tp * tn - fp * fn) / denominator)


#: name -> (aggregate of truth and prediction, whether more is better); `None` has no direction.
REGRESSION: dict[str, tuple[Callable[[Column, Column], Column], bool | None]] = {
    "mae": (mae, False),
    "rmse": (rmse, False),
    "r2": (r2, True),
    "rounded_accuracy": (rounded_accuracy, True),
    "within_one": (within_one, True),
    "underprediction_rate": (underprediction_rate, False),
    "mean_excess": (mean_excess, False),
}
#: Those that only make sense for whole numbers as truth.
INTEGER = ("rounded_accuracy", "within_one", "underprediction_rate", "mean_excess")

#: name -> (column of confusion counts, whether more is better).
CLASSIFICATION: dict[str, tuple[Callable[[dict[str, Column]], Column], bool]] = {
    "accuracy": (lambda c: _ratio(c["tp"] + c["tn"], c["tp"] + c["fp"] + c["fn"] + c["tn"]), True),
    "balanced_accuracy": (balanced_accuracy, True),
    "precision": (precision, True),
    "recall": (recall, True),
    "f1": (f1, True),
    "mcc": (mcc, True),
}
