"""Invariants of splits: coverage, determinism, independence of row order, no leaks, proportions."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks, splits


def rows(spark, n=60, groups=12):
    return spark.createDataFrame([(f"s-{i:03d}", f"g-{i % groups:02d}", "ab"[i % 3 == 0]) for i in range(n)], "id string, grp string, cls string")


def sequential(ids, seed, ratios):
    import hashlib

    order = sorted(ids, key=lambda i: hashlib.sha256(f"{seed}::{i}".encode()).hexdigest())
    given, out = [0] * 4, {}
    for i in order:
        k = min((j for j in range(4) if ratios[j] > 0), key=lambda j: (given[j] - ratios[j] * len(order), j))
        given[k] += 1
        out[i] = splits.SPLITS[k]
    return out


@pytest.mark.parametrize("ratios", [(0.7, 0.1, 0.1, 0.1), (0.5, 0.2, 0.1, 0.2), (0.8, 0.0, 0.0, 0.2)])
@pytest.mark.parametrize("n", [1, 7, 60])
def test_slots_are_the_sequential_rule(spark, ratios, n):
    data = rows(spark, n)
    got = {r.sample_id: r.split for r in splits.split_rows(data, "id", ratios, 3).collect()}
    assert got == sequential([r.id for r in data.collect()], 3, ratios)


def test_order_of_rows_has_no_effect_but_the_seed_has(spark):
    data = rows(spark)
    a, b = (sorted(splits.split_rows(d, "id", (0.7, 0.1, 0.1, 0.1), 1).collect()) for d in (data, data.orderBy(F.desc("id"))))
    assert a == b and len(a) == 60
    assert a != sorted(splits.split_rows(data, "id", (0.7, 0.1, 0.1, 0.1), 2).collect())


def test_groups_do_not_leak(spark):
    data = rows(spark)
    for label in (None, "cls"):
        found = splits.split_groups(data, "id", "grp", (0.5, 0.2, 0.1, 0.2), 5, label)
        assert found.count() == 60 and found.groupBy("unit").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0


def test_broken_assignments_are_counted(spark):
    data = rows(spark, 6, 2)
    bad = spark.createDataFrame([("s-000", "train"), ("s-002", "test"), ("s-001", "nowhere"), ("s-001", "train"), ("zz", "test")], "sample_id string, split string")
    r = splits.check_assignment(bad, data, "id", "grp", ("train", "test", "validation")).first()
    assert (r.unknown_splits, r.repeated_ids, r.empty_splits, r.missing_ids, r.extra_ids, r.leaking_groups) == (1, 1, 1, 3, 1, 2)
    with pytest.raises(checks.DataError, match="leaking_groups: 2"):
        checks.require(splits.check_assignment(bad, data, "id", "grp", ("train",)))


@pytest.mark.parametrize("ratios", [(0.7, 0.1, 0.1), (0.7, 0.2, 0.2, 0.1), (1.0, 0.0, 0.0, 0.0), (1.1, -0.1, 0.0, 0.0)])
def test_ratios_are_checked(ratios):
    with pytest.raises(ValueError):
        splits.check_ratios(ratios)


def test_ranks_with_a_common_value(spark):
    from plumbline.operators.ordered import with_rank

    data = spark.createDataFrame([(i, 1.0 if i % 3 else float(i)) for i in range(500)], "id long, x double")
    got = {r.id: r.rank for r in with_rank(data, [], F.col("x"), F.col("id"), buckets=8).collect()}
    want = {r.id: i + 1 for i, r in enumerate(sorted(data.collect(), key=lambda r: (r.x, r.id)))}
    assert got == want


def test_early_stop(spark):
    losses = [(0, 5.0), (1, 4.0), (2, 4.5), (3, 4.2), (4, 4.1), (5, 1.0)]
    data = spark.createDataFrame([("a", e, x) for e, x in losses], "run string, epoch int, loss double")
    assert splits.early_stop(data, ["run"], "epoch", "loss", 3).first().epoch == 1
    assert splits.early_stop(data, ["run"], "epoch", "loss", 4).first().epoch == 5
