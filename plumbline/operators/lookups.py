"""Joins by stable ids, and by bands and distances, that say what happens to rows without a partner."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lookup(samples: DataFrame, features: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Samples with the asked columns, in the asked order. A sample without a row is an error, further rows aren't
    looked at, and two rows of one key are an error too rather than a choice. Repeated keys are found by
    counts of keys alone; both joins share one partitioning."""
    repeated = features.groupBy(key).count().filter("count > 1").select(key, F.lit(True).alias("_twice"))
    right = features.select(key, F.struct(*columns).alias("_row"))
    joined = samples.join(right, key, "left").join(repeated, key, "left")
    wrong = F.when(F.col("_row").isNull(), F.lit("no features for ")).when(F.col("_twice"), F.lit("repeated features for "))
    checked = F.when(wrong.isNull(), F.col("_row")).otherwise(F.raise_error(F.concat(wrong, F.col(key).cast("string"))))
    return joined.withColumn("_row", checked).select(*samples.columns, *(F.col(f"_row.{c}").alias(c) for c in columns))


def subset(features: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    return features.join(samples.select(key), key, "left_semi")


def excluded(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.join(others.select(key), key, "left_anti")


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(only_left, only_right): ids of one side that the other hasn't."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").agg(F.count("*").alias("only_left")).crossJoin(b.join(a, key, "left_anti").agg(F.count("*").alias("only_right")))


def first_known(rows: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """`rows` with `path`: that of the first source (key, path) that has one; later sources only fill gaps.

    Of several paths of one key in a source the first in order counts, so rows are never doubled."""
    out, names = rows, []
    for i, source in enumerate(sources):
        names.append(f"_p{i}")
        out = out.join(source.groupBy(key).agg(F.min("path").alias(f"_p{i}")), key, "left")
    return out.withColumn("path", F.coalesce(*names)).drop(*names)


def band_join(rows: DataFrame, value: Column, bands: DataFrame) -> DataFrame:
    """Rows with the band (lower, upper, ...) whose half-open range holds the value; null bounds are open.

    Bands are a short list, so each task holds them: their number is checked, beyond it Spark chooses."""
    some = bands.select(*bands.columns)
    held = F.broadcast(some) if some.limit(10_001).count() <= 10_000 else some
    return rows.join(held, (F.coalesce(F.col("lower"), F.lit(float("-inf"))) <= value) & (value < F.coalesce(F.col("upper"), F.lit(float("inf")))))


def grid_product(spark: SparkSession, values: dict[str, Sequence]) -> DataFrame:
    """(position, names...): all combinations of a few values for each name, the last name changing fastest.

    Lists that a person writes, so rows are few; each list is a frame of its own and Spark crosses them."""
    if not values or not all(values.values()):
        raise ValueError("every name needs a value")
    out, before = spark.range(1).select(F.lit(0).cast("long").alias("position")), ["position"]
    for name, some in values.items():
        one = spark.createDataFrame([(i, x) for i, x in enumerate(some)], ["_at", name])
        out = out.crossJoin(one).withColumn("position", F.col("position") * len(some) + F.col("_at")).drop("_at")
        before.append(name)
    return out.select(*before)


#: Points and queries that meet in one task, at most, and pairs of them that are compared at once.
CELL, PAIRS = 4096, 1 << 19
#: What rows that meet have in common, and where they are.
MEETING, POSITION = ["_g", "_x", "_y", "_z", "_a", "_b"], ["_p0", "_p1", "_p2"]


def met_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """(rows, askers, points): pairs of places in `rows` that meet, all those of an asker in one meeting together.

    Rows come as `meetings` deals them. Meetings are mostly small, so all that a batch holds whole are paired at once."""
    held = None
    for batch in batches:
        held = batch if held is None or not len(held) else pd.concat([held, batch], ignore_index=True)
        new = np.zeros(len(held), bool)
        for k in MEETING:
            column = held[k].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        if new.any():
            cut = int(np.flatnonzero(new)[-1])
            yield from _paired(held.iloc[:cut], new[:cut])
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield from _paired(held, np.zeros(len(held), bool))


def _paired(rows: pd.DataFrame, new: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    meeting = np.cumsum(new)
    asks = rows["_asks"].to_numpy(bool)
    # points stand before askers in each meeting
    first = np.searchsorted(meeting, np.arange(meeting[-1] + 1))
    count = np.bincount(meeting[~asks], minlength=len(first))
    who = np.flatnonzero(asks & (count[meeting] > 0))
    many = count[meeting[who]]
    done = np.cumsum(many)
    for block in np.split(who, np.searchsorted(done, np.arange(PAIRS, done[-1], PAIRS))) if len(who) else []:
        n = count[meeting[block]]
        start = np.repeat(first[meeting[block]] - (np.cumsum(n) - n), n)
        if len(n):
            yield rows, np.repeat(block, n), start + np.arange(int(n.sum()))


def gaps(rows: pd.DataFrame, askers: np.ndarray, points: np.ndarray) -> np.ndarray:
    """From askers to points, a row for each pair."""
    p = rows[POSITION].to_numpy(np.float64)
    return p[points] - p[askers]


def _nearest(group: str, key: str, radius: float, k: int, digits: int | None):
    """The k nearest others within the radius for each asker of a meeting, ties by key."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, askers, points in met_pairs(batches):
            gap, ids = gaps(rows, askers, points), rows["_id"].to_numpy()
            distance = np.sqrt(gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2])
            some = np.flatnonzero((distance <= radius) & (ids[points] != ids[askers]))
            askers, points, distance = askers[some], points[some], distance[some]
            # points stand in the order of their keys
            order = np.lexsort((points, distance if digits is None else np.round(distance, digits), askers))
            askers, points, distance = askers[order], points[order], distance[order]
            start = np.concatenate(([0], np.flatnonzero(np.diff(askers)) + 1)) if len(askers) else np.zeros(0, int)
            place = np.arange(len(askers)) - np.repeat(start, np.diff(np.append(start, len(askers))))
            near = place < k
            yield pd.DataFrame({group: rows["_g"].to_numpy()[askers[near]], key: ids[askers[near]], "other": ids[points[near]], "distance": distance[near]})

    return nearest


def meetings(points: DataFrame, asks: DataFrame, radius: float) -> DataFrame:
    """Rows (_g, _id, _asks, `MEETING`, `POSITION`), dealt to tasks so that those of one meeting come one after the other, points first.

    Points (_g, _id, _p, a three-dimensional array) are in grid cells as wide as the radius: each goes to its own,
    and each of `asks` (the same columns) asks in the 27 around its own, so distant points never meet. A cell
    with more points or askers than `CELL` is cut into parts by their hashes, each part of points
    meeting each of askers: an asker meets each point in one place only."""
    cell = F.transform("_p", lambda x: F.floor(x / radius).cast("long"))
    steps = F.array(*(F.array(*(F.lit(s).cast("long") for s in (a, b, c))) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
    own = points.select("_g", "_id", "_p", cell.alias("_cell"), F.lit(False).alias("_asks"))
    asks = asks.select("_g", "_id", "_p", F.explode(F.transform(steps, lambda s: F.zip_with(s, cell, lambda a, b: a + b))).alias("_cell"), F.lit(True).alias("_asks"))
    sizes = own.groupBy("_g", "_cell").agg(F.count("*").alias("_points")).join(asks.groupBy("_g", "_cell").agg(F.count("*").alias("_askers")), ["_g", "_cell"])
    sizes = sizes.select("_g", "_cell", F.ceil(F.col("_points") / CELL).cast("int").alias("_of_points"), F.ceil(F.col("_askers") / CELL).cast("int").alias("_of_askers"))
    whole = own.unionByName(asks).join(sizes, ["_g", "_cell"])
    mine = lambda parts: F.array(F.pmod(F.xxhash64("_id"), F.col(parts)).cast("int"))
    every = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    whole = whole.withColumn("_a", F.explode(F.when(F.col("_asks"), mine("_of_askers")).otherwise(every("_of_askers"))))
    whole = whole.withColumn("_b", F.explode(F.when(F.col("_asks"), every("_of_points")).otherwise(mine("_of_points"))))
    named = (F.get("_cell", i).alias(n) for i, n in enumerate(("_x", "_y", "_z")))
    whole = whole.select("_g", *named, "_a", "_b", "_id", "_asks", *(F.get("_p", i).cast("double").alias(n) for i, n in enumerate(POSITION)))
    n = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return whole.repartition(n, *MEETING).sortWithinPartitions(*MEETING, "_asks", "_id")


def nearest_within(points: DataFrame, group: str, key: str, position: str, radius: float, k: int, asks: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(group, key, other, distance, place): the k nearest other points of the group within the radius, ties by key.

    Points (a three-dimensional array in `position`) meet as in `meetings`; what a
    meeting hands on are its k nearest for each asker, however many are within the radius. Rows without a
    group, key or position ask nothing and are nobody's neighbours. `asks` are the rows that ask, all points
    if it isn't given; with `digits` distances that agree to so many are ties, as those of symmetric places are but for rounding."""
    named = lambda rows: rows.select(F.col(group).alias("_g"), F.col(key).alias("_id"), F.col(position).alias("_p")).dropna()
    some = named(points)
    kinds = {f.name: f.dataType.simpleString() for f in some.schema}
    schema = f"{group} {kinds['_g']}, {key} {kinds['_id']}, other {kinds['_id']}, distance double"
    met = meetings(some, some if asks is None else named(asks), radius).mapInPandas(_nearest(group, key, radius, k, digits), schema)
    w = Window.partitionBy(group, key).orderBy("distance" if digits is None else F.round("distance", digits), "other")
    return met.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
