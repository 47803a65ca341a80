"""Deterministic, leakage-checked assignment of samples to train, validation, calibration and test."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import with_group, with_rank

SPLITS = ("train", "validation", "calibration", "test")
#: Slots that one row makes.
SLOTS = 100_000


def check_ratios(ratios: Sequence[float]) -> None:
    """Four ratios, none below 0, train and test above 0, that sum to 1 within 1e-9."""
    if len(ratios) != len(SPLITS) or any(r < 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("split ratios must be four numbers of at least 0 that sum to 1")
    if ratios[0] <= 0 or ratios[3] <= 0:
        raise ValueError("train and test need a positive ratio")


def shuffle_key(seed: int, stratum: Column, unit: Column) -> Column:
    """SHA-256 of seed, stratum and unit: an order of our own, the same for any order of rows. Nulls count as empty texts."""
    empty = F.lit("")
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(stratum, empty), F.coalesce(unit, empty)).cast("binary"), 256)


def split_rows(rows: DataFrame, sample_id: str, ratios: Sequence[float], seed: int, stratum: str | None = None) -> DataFrame:
    """(sample_id, stratum, split) for units of one row each.

    The rule gives each unit, in shuffled order, to the split that is furthest below its share, the first
    of equals. For units of size one that depends on positions only: split s has slots at k - ratio * n for
    k = 0, 1, ..., and position i takes the i-th slot. Rows without a stratum are one of their own. A slot's place is counted from its own numbers, so
    slots are made in runs and joined, never sorted; samples are ranked in buckets."""
    check_ratios(ratios)
    strata = F.col(stratum).cast("string") if stratum else F.lit("")
    samples = rows.select(F.col(sample_id).cast("string").alias("sample_id"), strata.alias("stratum"))
    hashed = samples.withColumn("_key", shuffle_key(seed, F.col("stratum"), F.col("sample_id")))
    # the leading digits order rows in buckets; the whole key settles the rest
    lead = F.conv(F.substring("_key", 1, 13), 16, 10).cast("long")
    placed = with_rank(hashed, ["stratum"], lead, F.col("_key"), "position").drop("_key")
    sizes = samples.groupBy("stratum").agg(F.count("*").alias("n"))
    shares = [(i, split, float(r)) for i, (split, r) in enumerate(zip(SPLITS, ratios)) if r > 0]
    each = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(split).alias("split"), F.lit(r).alias("ratio")) for i, split, r in shares))
    runs = sizes.select("stratum", "n", F.explode(each).alias("s")).select("stratum", "n", "s.*")
    last = F.ceil(F.col("ratio") * F.col("n")) + 1
    runs = runs.withColumn("last", last).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(SLOTS).cast("long"))))
    k = F.explode(F.sequence("first", F.least(F.col("first") + SLOTS - 1, F.col("last"))))
    slots = runs.withColumn("k", k).withColumn("at", F.col("k") - F.col("ratio") * F.col("n"))
    position = F.lit(1).cast("long")
    for i, _, r in shares:
        start = r * F.col("n")
        # all slots of that split up to this number are before; of the next few, each is compared as it is
        sure = F.greatest(F.lit(0).cast("long"), F.floor(F.col("at") + start) - 1)
        near = [(sure + j) - start for j in range(4)]
        before = [((x < F.col("at")) | ((x == F.col("at")) & (F.lit(i) < F.col("ordinal")))).cast("long") for x in near]
        position = position + sure + before[0] + before[1] + before[2] + before[3]
    slots = slots.select("stratum", "split", position.alias("position"))
    return with_group(placed, slots, ["stratum", "position"]).select("sample_id", "stratum", "split")


def majority(rows: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """The most frequent label of each group and how often it occurs; of equals, the smallest."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col(label).alias("label")))
    return counts.groupBy(*by).agg(best.alias("best")).select(*by, F.col("best.label").alias("majority"), (-F.col("best.less")).alias("n"))


def unit_sizes(rows: DataFrame, group: str, label: str | None = None) -> DataFrame:
    """(unit, size, stratum) of groups; the stratum is the group's majority label, or one for all.

    A group of which no row has a label has a null stratum. A row without a group is an error."""
    there = F.when(F.col(group).isNotNull(), F.col(group).cast("string")).otherwise(F.raise_error(F.lit("every sample needs a group")).cast("string"))
    rows = rows.withColumn(group, there)
    units = rows.groupBy(F.col(group).cast("string").alias("unit")).agg(F.count("*").alias("size"))
    if label is None:
        return units.withColumn("stratum", F.lit(""))
    most = majority(rows.select(F.col(group).cast("string").alias("unit"), F.col(label).cast("string").alias("label")), ["unit"], "label")
    return units.join(most.select("unit", F.col("majority").alias("stratum")), "unit", "left")


def _dealer(ratios: Sequence[float]):
    """Deals out one stratum's units in shuffled order, from a heap of splits by how far each is over its share."""

    def deal(units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["key", "unit"], kind="stable")
        wanted = {at: ratio * float(units["size"].sum()) for at, ratio in enumerate(ratios) if ratio > 0}
        held = dict.fromkeys(wanted, 0)
        heap = [(-rows, at) for at, rows in wanted.items()]
        heapq.heapify(heap)
        chosen = []
        for size in units["size"].tolist():
            at = heap[0][1]
            held[at] += size
            heapq.heapreplace(heap, (held[at] - wanted[at], at))
            chosen.append(SPLITS[at])
        return pd.DataFrame({"unit": units["unit"].to_numpy(), "split": chosen})

    return deal


def split_groups(rows: DataFrame, sample_id: str, group: str, ratios: Sequence[float], seed: int, label: str | None = None) -> DataFrame:
    """(sample_id, unit, split): whole groups go to a split, so no group leaks. A row without a group is an error.

    The rule is sequential in each stratum, over its units only: one task gets a row of some 100 bytes for
    each group of a stratum, so 10 million groups are a gigabyte; samples join its decisions back."""
    check_ratios(ratios)
    units = unit_sizes(rows, group, label).withColumn("key", shuffle_key(seed, F.col("stratum"), F.col("unit")))
    decided = units.groupBy("stratum").applyInPandas(_dealer(ratios), "unit string, split string")
    samples = rows.select(F.col(sample_id).cast("string").alias("sample_id"), F.col(group).cast("string").alias("unit"))
    return samples.join(decided, "unit").select("sample_id", "unit", "split")


def check_assignment(assignment: DataFrame, samples: DataFrame, sample_id: str, group: str | None, required: Sequence[str]) -> DataFrame:
    """One row of counts: unknown splits, ids missing, ids unknown, ids assigned twice, required splits left
    empty, and groups in more than one split. All zero: the assignment holds."""
    known = samples.select(F.col(sample_id).cast("string").alias("sample_id"), *([F.col(group).cast("string").alias("unit")] if group else []))
    given = assignment.select(F.col("sample_id"), F.col("split"))
    both = known.join(given, "sample_id", "full_outer" if not group else "left")
    leaks = F.lit(0).cast("long")
    found = given.agg(
        F.count_if(~F.col("split").isin(*SPLITS)).alias("unknown_splits"),
        (F.count("*") - F.count_distinct("sample_id")).alias("repeated_ids"),
        (F.lit(len(required)) - F.count_distinct(F.when(F.col("split").isin(*required), F.col("split")))).alias("empty_splits"),
    )
    missing = known.join(given, "sample_id", "left_anti").agg(F.count("*").alias("missing_ids"))
    extra = given.join(known, "sample_id", "left_anti").agg(F.count("*").alias("extra_ids"))
    if group:
        per = both.filter("unit is not null").groupBy("unit").agg((F.count_distinct("split") > 1).alias("leaks"))
        leaking = per.agg(F.count_if("leaks").alias("leaking_groups"))
    else:
        leaking = given.limit(0).agg(leaks.alias("leaking_groups"))
    return found.crossJoin(missing).crossJoin(extra).crossJoin(leaking)


def partition(samples: DataFrame, sample_id: str, assignment: DataFrame) -> DataFrame:
    """Samples with their split; those that have none aren't in it."""
    return samples.withColumn("sample_id", F.col(sample_id).cast("string")).join(assignment.select("sample_id", "split"), "sample_id")


def hash_sample(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """`size` rows without replacement: those with the smallest hashes. A sampling operator: the limit is its point."""
    drawn = rows.withColumn("_draw", shuffle_key(seed, F.lit(""), F.col(key).cast("string")))
    return drawn.orderBy("_draw", key).limit(size).drop("_draw")


def first_by_content(rows: DataFrame, content: Column, position: str) -> DataFrame:
    """Of rows with the same content, the first by position; aggregation, so copies meet before they are shuffled."""
    names = rows.columns
    keyed = rows.withColumn("_content", F.sha2(content.cast("binary"), 256))
    first = keyed.groupBy("_content").agg(F.min_by(F.struct(*names), position).alias("row"))
    return first.select("row.*")


def early_stop(losses: DataFrame, by: Sequence[str], epoch: str, loss: str, patience: int) -> DataFrame:
    """The best epoch before `patience` epochs in a row without a smaller loss. A group is one training's epochs."""
    w = Window.partitionBy(*by).orderBy(epoch)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    step = losses.withColumn("_at", F.row_number().over(w)).withColumn("_best", F.min(loss).over(before))
    step = step.withColumn("_better", F.col("_best").isNull() | (F.col(loss) < F.col("_best")))
    step = step.withColumn("_last", F.max(F.when(F.col("_better"), F.col("_at"))).over(w))
    stop = F.min(F.when(F.col("_at") - F.col("_last") >= patience, F.col("_at"))).over(Window.partitionBy(*by))
    ran = step.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("_at") <= F.col("_stop")))
    return ran.filter("_better").groupBy(*by).agg(F.max_by(epoch, "_at").alias("epoch"), F.max_by(loss, "_at").alias("loss"))
