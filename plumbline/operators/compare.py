"""Two runs over the same ids: how far they differ, and whether that is allowed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate


def differences(left: DataFrame, right: DataFrame, key: str, value: str, cut: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, only_left, only_right, max_diff, mean_diff, worst, flips, closest, closest_margin).

    `flips` are rows that fall on different sides of the cut, `closest` the row of the left run nearest to
    it. Ids that one run lacks are counted, not dropped; those of the right run only are counted in their
    group if that run has the columns of `by` too, else in one without."""
    a = left.select(F.col(key), F.col(value).cast("double").alias("_a"), *by)
    other = [c for c in by if c in right.columns]
    b = right.select(F.col(key), F.col(value).cast("double").alias("_b"), F.lit(True).alias("_there"), *(F.col(c).alias(f"_b_{c}") for c in other))
    both = a.withColumn("_here", F.lit(True)).join(b, key, "full_outer").withColumns({c: F.when(F.col("_here"), F.col(c)).otherwise(F.col(f"_b_{c}")) for c in other})
    diff = F.abs(F.col("_a") - F.col("_b"))
    margin = F.abs(F.col("_a") - cut)
    worst = F.min(F.when(diff.isNotNull(), F.struct((-diff).alias("d"), F.col(key).alias("k")))).alias("_w")
    near = F.min(F.when(diff.isNotNull(), F.struct(margin.alias("m"), F.col(key).alias("k")))).alias("_c")
    out = both.groupBy(*by).agg(
        F.count(diff).alias("n"), F.count_if(F.col("_there").isNull()).alias("only_left"), F.count_if(F.col("_here").isNull()).alias("only_right"),
        F.max(diff).alias("max_diff"), F.avg(diff).alias("mean_diff"), worst, F.count_if((F.col("_a") >= cut) != (F.col("_b") >= cut)).alias("flips"), near,
    )
    return out.select(
        *by, "n", "only_left", "only_right", "max_diff", "mean_diff", F.col("_w.k").alias("worst"), "flips",
        F.col("_c.k").alias("closest"), F.col("_c.m").alias("closest_margin"),
    )


def verdict(found: DataFrame, tolerance: float) -> DataFrame:
    same = (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("max_diff") <= tolerance)
    return found.withColumn("verdict", F.when(same & (F.col("flips") == 0), "same").when(same, "flips").otherwise("differs"))


def systems(preds: DataFrame, by: Sequence[str], positive, metrics: Sequence[str]) -> DataFrame:
    """Confusion metrics of several systems side by side: (system, by, ...)."""
    return evaluate.classification(preds, metrics, positive, ["system", *by])


def report(rows: list[dict], columns: Sequence[str]) -> str:
    """A Markdown table of a few aggregated rows."""
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*head, *("| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows)]) + "\n"
