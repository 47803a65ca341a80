"""Grouped, banded and per-class evaluation of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.scalars import band_edges, band_label


def number(name: str) -> Column:
    """A column as a double, null where it is NaN: what isn't a number is in no metric."""
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x), x)


def _pair(truth: str, prediction: str) -> tuple[Column, Column]:
    """Truth and prediction as doubles, both null where either is null or NaN."""
    y, p = number(truth), number(prediction)
    return F.when(p.isNotNull(), y), F.when(y.isNotNull(), p)


def regression(preds: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """One row for each group: n and each metric, all from one aggregation.

    Rows without a truth or a prediction, null or NaN, are in no metric and not in n."""
    y, p = _pair(truth, prediction)
    unknown = set(metrics) - M.REGRESSION.keys()
    if unknown:
        raise ValueError(f"no regression metrics: {sorted(unknown)}")
    whole = set(metrics) & set(M.INTEGER)
    checked = F.when(F.count_if(y != F.floor(y)) == 0, F.count(y)).otherwise(F.raise_error(F.lit("the metrics need whole numbers")).cast("long"))
    n = checked if whole else F.count(y)
    return preds.groupBy(*by).agg(n.alias("n"), *(M.REGRESSION[m][0](y, p).alias(m) for m in metrics))


def intervals(preds: DataFrame, by: Sequence[str] = (), levels: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Coverage, mean width, and the pinball loss of lower, median and upper and their mean.

    Rows without a truth or an interval are in no metric and not in n; an interval of one end is an error."""
    y, lo, mid, up = map(number, ("truth", "lower", "median", "upper"))
    y = F.when(lo.isNotNull() & mid.isNotNull() & up.isNotNull(), y)
    losses = [M.pinball(y, q, level) for q, level in zip((lo, mid, up), levels)]
    present = F.count_if(lo.isNull() != up.isNull())
    n = F.when(present == 0, F.count(y)).otherwise(F.raise_error(F.lit("an interval needs both ends")).cast("long"))
    named = [loss.alias(f"pinball_{level:g}".replace(".", "_")) for loss, level in zip(losses, levels)]
    mean = (losses[0] + losses[1] + losses[2]) / 3
    held = [F.when(y.isNotNull(), c) for c in (lo, up)]
    return preds.groupBy(*by).agg(
        n.alias("n"), M.interval_coverage(y, *held).alias("coverage"), M.mean_interval_width(*held).alias("width"), *named, mean.alias("pinball_mean")
    )


def classification(preds: DataFrame, metrics: Sequence[str], positive, by: Sequence[str] = (), truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """One row for each group: counts of the confusion matrix and each metric. Rows without a truth or a prediction don't count."""
    c = M.confusion(F.col(truth), F.col(prediction), F.lit(positive))
    return preds.groupBy(*by).agg(
        F.count(F.when(F.col(truth).isNotNull(), F.col(prediction))).alias("n"), *(col.alias(k) for k, col in c.items()), *(M.CLASSIFICATION[m][0](c).alias(m) for m in metrics)
    )


def default_positive(preds: DataFrame, truth: str = "truth") -> str:
    """The last of two classes in order; an error if there are not two."""
    low, high, n = preds.agg(F.min(truth), F.max(truth), F.count_distinct(truth)).first()
    if n != 2:
        raise ValueError(f"there are {n} classes, not two")
    return high


def confusion_matrix(preds: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """(truth, prediction, n) for all pairs of classes that occur on either side, zeros included."""
    y, p = F.col(truth).cast("string"), F.col(prediction).cast("string")
    cells = preds.groupBy(y.alias("truth"), p.alias("prediction")).agg(F.count("*").alias("n"))
    classes = cells.select(F.explode(F.array("truth", "prediction")).alias("c")).distinct()
    # classes, not rows, meet each other here
    grid = classes.select(F.col("c").alias("truth")).crossJoin(classes.select(F.col("c").alias("prediction")))
    return grid.join(cells, ["truth", "prediction"], "left").select("truth", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def by_band(preds: DataFrame, edges: Sequence[float], metrics: Sequence[str], truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Metrics for each half-open band of the true value, empty bands with n = 0. r2 isn't for bands. Nulls and NaN are left out."""
    if "r2" in metrics:
        raise ValueError("r2 has no meaning in a band")
    y, p = number(truth), number(prediction)
    found = preds.filter(y.isNotNull() & p.isNotNull()).groupBy(band_label(y, edges).alias("band")).agg(F.count("*").alias("n"), *(M.REGRESSION[m][0](y, p).alias(m) for m in metrics))
    bands = preds.sparkSession.createDataFrame([(i, label) for i, (*_, label) in enumerate(band_edges(edges))], "position int, band string")
    return bands.join(found, "band", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).select("position", "band", "n", *metrics)


def summary(rows: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """Count, exact median and population deviation of a value in each group."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.stddev_pop(value).alias("deviation"))


#: Metrics of intervals and the columns of `intervals` that they are.
INTERVAL = {"interval_coverage": "coverage", "mean_interval_width": "width", "pinball": "pinball_mean"}


def everything(preds: DataFrame, metrics: Sequence[str], levels: Sequence[float] | None = None, bands: Sequence[float] = ()) -> tuple[DataFrame, DataFrame | None]:
    """(metrics by source and split, metrics by source, split and band) of regression predictions.

    Interval metrics are of rows with lower and upper, null where a source has none, and the loss of the middle level is of
    `median` where that is told; all other metrics are of what is published. Bands are of the true value and
    leave out r2 and intervals."""
    by, plain = ["source", "split"], [m for m in metrics if m not in INTERVAL]
    found = regression(preds, plain, by)
    if some := [m for m in metrics if m in INTERVAL]:
        middle = F.coalesce("median", "prediction") if "median" in preds.columns else F.col("prediction")
        whole = intervals(preds.withColumn("median", middle), by, levels)
        found = found.join(whole.select(*by, *(F.col(INTERVAL[m]).alias(m) for m in some)), by, "left")
    if not bands:
        return found.select(*by, "n", *metrics), None
    banded = [m for m in plain if m != "r2"]
    label = band_label(number("truth"), bands).alias("band")
    return found.select(*by, "n", *metrics), regression(preds.withColumn("band", label).filter("band is not null"), banded, [*by, "band"])
