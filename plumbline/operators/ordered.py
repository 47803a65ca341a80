"""Running sums and ranks over ordered rows that no single task has to hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

BUCKETS = 64


def with_group(rows: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """`rows` with the facts of their group. A null in a group column is a value like any other: no row is lost."""
    if not by:
        return rows.crossJoin(F.broadcast(facts))
    keys = {c: f"_of_{i}" for i, c in enumerate(by)}
    named = facts.withColumnsRenamed(keys)
    both = rows.join(named, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    return both.drop(*keys.values())


def _bounds(df: DataFrame, by: Sequence[str], order: Column, buckets: int) -> DataFrame:
    cuts = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    return df.groupBy(*by).agg(F.percentile_approx(order, cuts, 10_000).alias("_bounds"))


def _bucketed(df: DataFrame, by: Sequence[str], order: Column, buckets: int) -> DataFrame:
    """`df` with `_bucket`: the number of approximate quantiles below the row. Equal values share a bucket."""
    bounds = _bounds(df, by, order, buckets)
    return with_group(df, bounds, by).withColumn("_bucket", F.coalesce(F.size(F.filter("_bounds", lambda b: b < order)), F.lit(0))).drop("_bounds")


def _offsets(totals: DataFrame, by: Sequence[str], order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Exclusive running sums over buckets: at most BUCKETS squared rows for each group, so one task's window is short."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, *order, *(F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_before_{s}") for s in sums))


def running_sums(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """`df`, with one row for each value of `order` in a group, and `run_<s>`: inclusive running sums.

    Nulls of a group column form a group; so do nulls of `order`, which come first.
    Rows are dealt to buckets of approximate quantiles; a bucket sums its own rows, and sums of buckets
    are added. A group of any size is spread over all its buckets."""
    dealt = _bucketed(df, by, F.col(order), buckets)
    keys = [*by, "_bucket"]
    before = _offsets(dealt.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sums)), by, ["_bucket"], sums)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = with_group(dealt, before, keys)
    out = out.select("*", *((F.col(f"_before_{s}") + F.sum(s).over(w)).alias(f"run_{s}") for s in sums))
    return out.drop("_bucket", *(f"_before_{s}" for s in sums))


def with_rank(df: DataFrame, by: Sequence[str], order: Column, tie: Column, name: str = "rank", buckets: int = BUCKETS) -> DataFrame:
    """`df` with the row number in its group by `order` and then `tie`, from 1.

    Nulls of a group column form a group; a null order comes first, and so does a null tie.
    Buckets as in `running_sums`; a bucket that holds one value of `order` only, however often, is cut
    once more by quantiles of `tie` if that is a number. So neither a large group nor a common value
    falls to one task."""
    marked = df.withColumn("_order", order).withColumn("_tie", tie)
    dealt = _bucketed(marked, by, F.col("_order"), buckets)
    keys = [*by, "_bucket"]
    if not isinstance(marked.schema["_tie"].dataType, NumericType):
        dealt = dealt.withColumn("_second", F.lit(0))
        return _numbered(dealt, keys, by, name)
    cuts = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    stats = dealt.groupBy(*keys).agg(
        F.min("_order").eqNullSafe(F.max("_order")).alias("_one"), F.percentile_approx("_tie", cuts, 10_000).alias("_cuts")
    )
    second = F.when(F.col("_one"), F.size(F.filter("_cuts", lambda b: b < F.col("_tie")))).otherwise(F.lit(0))
    return _numbered(with_group(dealt, stats, keys).withColumn("_second", second).drop("_one", "_cuts"), keys, by, name)


def _numbered(dealt: DataFrame, keys: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    counts = dealt.groupBy(*keys, "_second").agg(F.count("*").alias("n"))
    before = _offsets(counts, by, ["_bucket", "_second"], ["n"])
    w = Window.partitionBy(*keys, "_second").orderBy("_order", "_tie")
    out = with_group(dealt, before, [*keys, "_second"]).withColumn(name, (F.col("_before_n") + F.row_number().over(w)).cast("long"))
    return out.drop("_order", "_tie", "_bucket", "_second", "_before_n")
