"""Windowed evaluation of a stream of predictions: sums that add up, under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sums(preds: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """(start, source, n, abs_error, squared_error, under) of tumbling windows; rows later than `late` are left out.

    Counts and sums are what can be kept for a stream: mean errors follow from them, ranks and medians don't."""
    y, p = F.col("truth").cast("double"), F.col("prediction").cast("double")
    return (
        preds.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, width), "source")
        .agg(F.count("*").alias("n"), F.sum(F.abs(y - p)).alias("abs_error"), F.sum((y - p) * (y - p)).alias("squared_error"), F.count_if(F.floor(p + 0.5) < y).alias("under"))
        .select(F.col("window.start").alias("start"), "source", "n", "abs_error", "squared_error", "under")
    )


def means(sums: DataFrame) -> DataFrame:
    """mae, rmse and rate of underprediction of windows, or of sums of windows."""
    return sums.select("start", "source", "n", (F.col("abs_error") / F.col("n")).alias("mae"), F.sqrt(F.col("squared_error") / F.col("n")).alias("rmse"), (F.col("under") / F.col("n")).alias("underprediction_rate"))
