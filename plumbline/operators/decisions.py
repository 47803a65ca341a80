"""Constrained selection: thresholds, decision levels, band offsets; and the calibration they rest on."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.scalars import band_edges, band_label
from .evaluate import number
from .ordered import running_sums, with_group
from .ranking import score_counts


def cuts(preds: DataFrame, score: str, is_positive) -> DataFrame:
    """Every threshold that tells rows apart and its confusion counts: one row for each distinct score and one more.

    Thresholds are the lowest score, the midpoints of neighbours, and the first number above the highest.
    A row is called positive from the threshold on. Counts come from running sums over distinct scores."""
    counts = score_counts(preds, [], score, is_positive)
    run = running_sums(counts, [], "score", ["pos", "neg"])
    highest, pos, neg = counts.agg(F.max("score"), F.sum("pos"), F.sum("neg")).first()
    if highest is None:
        return preds.sparkSession.createDataFrame([], "threshold double, tp long, fp long, fn long, tn long")
    below_pos, below_neg = F.col("run_pos") - F.col("pos"), F.col("run_neg") - F.col("neg")
    # the score before this one is in the row that has as many rows up to it as this one has below
    upto = (F.col("run_pos") + F.col("run_neg")).alias("upto")
    previous = run.select(F.col("score").alias("previous"), upto)
    rows = run.select("score", below_pos.alias("fn"), below_neg.alias("tn"), (below_pos + below_neg).alias("upto")).join(previous, "upto", "left")
    threshold = F.coalesce((F.col("previous") + F.col("score")) / 2, F.col("score"))
    some = rows.select(threshold.alias("threshold"), (F.lit(pos) - F.col("fn")).alias("tp"), (F.lit(neg) - F.col("tn")).alias("fp"), "fn", "tn")
    none = preds.sparkSession.createDataFrame(
        [(math.nextafter(highest, math.inf), 0, 0, pos, neg)], "threshold double, tp long, fp long, fn long, tn long"
    )
    return some.unionByName(none)


def select_threshold(preds: DataFrame, score: str, is_positive, metric: str, min_recall: float | None = None) -> DataFrame:
    """(threshold, value, recall): the best by the metric among thresholds that keep the recall, the lowest of equals."""
    c = {k: F.col(k) for k in ("tp", "fp", "fn", "tn")}
    scored = cuts(preds, score, is_positive).select("threshold", M.CLASSIFICATION[metric][0](c).alias("value"), M.recall(c).alias("recall"))
    allowed = scored if min_recall is None else scored.filter(F.col("recall") >= min_recall)
    # metrics that agree to nine digits are equal: sums of doubles may differ in the last
    return allowed.orderBy(F.desc(F.round("value", 9)), "threshold").limit(1)


def level_scores(preds: DataFrame, levels: dict[float, str], truth: str, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, level, n, value, rate): the metric and the rate of underprediction at each level's column, in one pass.

    Rows without a truth or without a level's value don't count there."""
    y = number(truth)
    at = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("level"), number(c).alias("p")) for q, c in sorted(levels.items()))))
    rows = preds.select(*by, y.alias("y"), at.alias("l")).select(*by, "y", "l.*").filter("y is not null and p is not null")
    # pre-aggregation needs a row for each level and task only
    return rows.groupBy(*by, "level").agg(
        F.count("*").alias("n"), M.REGRESSION[metric][0](F.col("y"), F.col("p")).alias("value"), M.underprediction_rate(F.col("y"), F.col("p")).alias("rate")
    )


def select_level(preds: DataFrame, levels: dict[float, str], truth: str, metric: str, max_rate: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, level, value, rate, feasible): the best level whose rate is at most `max_rate`, the lowest of equals.

    Where none is feasible the level is null and `rate` is the lowest rate there is."""
    more = M.REGRESSION[metric][1]
    cost = -F.col("value") if more else F.col("value")
    scored = level_scores(preds, levels, truth, metric, by).withColumn("cost", F.round(cost, 9))
    scored = scored.withColumn("ok", F.lit(True) if max_rate is None else F.col("rate") <= max_rate)
    best = F.min(F.when(F.col("ok"), F.struct("cost", "level", "value", "rate"))).alias("best")
    out = scored.groupBy(*by).agg(best, F.min("rate").alias("least"))
    return out.select(
        *by, F.col("best.level").alias("level"), F.col("best.value").alias("value"),
        F.coalesce("best.rate", "least").alias("rate"), F.col("best").isNotNull().alias("feasible"),
    )


def band_offsets(preds: DataFrame, truth: str, value: str, edges: Sequence[float], max_rate: float, max_offset: int = 8) -> DataFrame:
    """(position, band, n, offset, rate, feasible): for each band of the rounded value, the smallest offset that
    keeps underpredictions to `max_rate`, or the largest offset there is; empty bands get 0. Rows without a
    truth or a value don't count.

    A row is below the truth at offsets under one number; counts by band and that number are enough."""
    y, p = number(truth), M.half_up(number(value))
    needed = F.greatest(F.lit(0), F.least(F.lit(max_offset + 1), F.ceil(y - p).cast("int")))
    counts = preds.filter(y.isNotNull() & p.isNotNull()).groupBy(band_label(p, edges).alias("band"), needed.alias("needed")).agg(F.count("*").alias("rows"))
    trials = counts.select("band", "rows", "needed", F.explode(F.sequence(F.lit(0), F.lit(max_offset))).alias("offset"))
    rates = trials.groupBy("band", "offset").agg((F.sum(F.when(F.col("needed") > F.col("offset"), F.col("rows")).otherwise(0)) / F.sum("rows")).alias("rate"), F.sum("rows").alias("n"))
    ok = F.min(F.when(F.col("rate") <= max_rate, F.struct("offset", "rate"))).alias("ok")
    found = rates.groupBy("band").agg(ok, F.max(F.struct("offset", "rate")).alias("last"), F.max("n").alias("n"))
    bands = preds.sparkSession.createDataFrame([(i, label) for i, (*_, label) in enumerate(band_edges(edges))], "position int, band string")
    chosen = F.coalesce("ok", "last")
    return bands.join(found, "band", "left").select(
        "position", "band", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(chosen["offset"], F.lit(0)).alias("offset"),
        F.coalesce(chosen["rate"], F.lit(0.0)).alias("rate"), (F.col("ok").isNotNull() | F.col("n").isNull()).alias("feasible"),
    )


def level_by_band(preds: DataFrame, levels: dict[float, str], truth: str, median: str, edges: Sequence[float], metric: str, max_rate: float | None = None) -> DataFrame:
    """(band, level, value, rate, feasible): a level for each band of the rounded median; an empty band is an error."""
    banded = preds.withColumn("band", band_label(M.half_up(F.col(median).cast("double")), edges))
    bands = preds.sparkSession.createDataFrame([(label,) for *_, label in band_edges(edges)], "band string")
    chosen = bands.join(select_level(banded, levels, truth, metric, max_rate, ["band"]), "band", "left")
    empty = F.raise_error(F.concat(F.lit("no rows in band "), F.col("band"))).cast("boolean")
    return chosen.withColumn("feasible", F.when(F.col("rate").isNotNull(), F.col("feasible")).otherwise(empty))


def conformal_correction(rows: DataFrame, truth: str, lower: str, upper: str, coverage: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, correction): the k-th smallest of max(lower - y, y - upper), k = min(n, ceil((n + 1) coverage)).

    `coverage` is a double as it comes, so that the ceiling doesn't jump. Rows are counted by score first and
    counts are added up in buckets."""
    y = number(truth)
    below, above = number(lower) - y, y - number(upper)
    # of one end alone nothing can be said
    scores = rows.select(*by, F.when(below.isNotNull() & above.isNotNull(), F.greatest(below, above)).alias("s")).filter("s is not null")
    counts = scores.groupBy(*by, "s").agg(F.count("*").alias("rows"))
    sizes = counts.groupBy(*by).agg(F.sum("rows").alias("n"))
    k = F.least(F.col("n"), F.ceil((F.col("n") + 1).cast("double") * F.lit(float(coverage))).cast("long"))
    run = running_sums(counts, by, "s", ["rows"])
    joined = with_group(run, sizes, by)
    return joined.filter(F.col("run_rows") >= k).groupBy(*by, "n").agg(F.min("s").alias("correction"))


def ordered_levels(rows: DataFrame, levels: Sequence[str], room: float = 1e-3) -> DataFrame:
    """`rows` with `ordered`: whether the levels are finite and don't fall by more than room * max(1, |largest|)."""
    columns = [F.col(c).cast("double") for c in levels]
    limit = F.lit(room) * F.greatest(F.lit(1.0), *(F.abs(c) for c in columns))
    finite = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns]
    steps: list[Column] = [a <= b + limit for a, b in zip(columns, columns[1:])]
    ok = finite[0]
    for c in [*finite[1:], *steps]:
        ok = ok & c
    return rows.withColumn("ordered", F.coalesce(ok, F.lit(False)))
