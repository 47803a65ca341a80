"""Every registered query that has SQL gives what DuckDB gives."""

import glob
import os

import duckdb
import pytest

from plumbline.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(None if x != x else x for x in r) for r in frame.astype(object).itertuples(index=False)), key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf, duck):
    got, want = rows_of(QUERIES[name](spark, sf).toPandas()), rows_of(duck.execute(SQL[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9) if all(isinstance(x, (int, float)) for x in a) else a == b


def test_forests_are_finite_and_monotone(spark, sf):
    found = QUERIES["quantile_forest"](spark, sf).groupBy("vec_id").pivot("level", [0.05, 0.5, 0.95]).sum("value").collect()
    assert found and all(r[1] <= r[2] <= r[3] for r in found)
    scores = [r.score for r in QUERIES["class_weighted_forest"](spark, sf).collect()]
    assert len(scores) == 500 and all(0 <= s <= 1 for s in scores)
