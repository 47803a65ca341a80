"""Operators over gaps, ties, crowded cells and malformed input, against naive versions."""

import gzip
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import checks, compare, decisions, evaluate, features, fits, lookups, ordered, ranking, splits
from plumbline.sources import readers, writers


def test_null_groups_lose_no_row(spark):
    rows = spark.createDataFrame([(f"s{i}", None if i % 4 == 0 else f"g{i % 5}", i % 7) for i in range(100)], "id string, grp string, x int")
    found = splits.split_rows(rows, "id", (0.7, 0.1, 0.1, 0.1), 1, "grp")
    assert found.count() == 100 and found.filter("stratum is null").count() == 25
    sizes = {r.split: r["count"] for r in found.filter("stratum is null").groupBy("split").count().collect()}
    assert sizes["train"] in (17, 18) and sum(sizes.values()) == 25
    assert ordered.with_rank(rows, ["grp"], F.col("x"), F.col("id")).count() == 100
    got = {(r.grp, r.id): r.rank for r in ordered.with_rank(rows, ["grp"], F.col("x"), F.col("id"), buckets=4).collect()}
    for g in {r.grp for r in rows.collect()}:
        mine = sorted((r for r in rows.collect() if r.grp == g), key=lambda r: (r.x, r.id))
        assert [got[g, r.id] for r in mine] == list(range(1, len(mine) + 1))
    sums = ordered.running_sums(rows.groupBy("grp", "x").agg(F.count("*").alias("n")), ["grp"], "x", ["n"])
    assert sums.filter("grp is null").agg(F.max("run_n")).first()[0] == 25
    with pytest.raises(Exception, match="needs a group"):
        splits.split_groups(rows, "id", "grp", (0.7, 0.1, 0.1, 0.1), 1).collect()
    unlabelled = rows.withColumn("grp", F.coalesce("grp", F.lit("none"))).withColumn("y", F.when(F.col("grp") != "none", "a"))
    assert splits.split_groups(unlabelled, "id", "grp", (0.7, 0.1, 0.1, 0.1), 1, "y").count() == 100


@pytest.mark.parametrize("ratios", [(0.7, 0.1, 0.1, 0.1), (0.6, 0.0, 0.2, 0.2), (0.25, 0.25, 0.25, 0.25)])
def test_units_go_where_most_is_lacking(ratios):
    import pandas as pd

    r = np.random.default_rng(2)
    units = pd.DataFrame({"unit": [f"u{i}" for i in range(40)], "size": r.integers(1, 9, 40), "key": r.permutation(40).astype(str), "stratum": ""})
    got = splits._dealer(ratios)(units)
    total, given = int(units["size"].sum()), [0] * 4
    for (_, u), split in zip(units.sort_values(["key", "unit"]).iterrows(), got["split"]):
        lacking = [ratios[k] * total - given[k] if ratios[k] else -np.inf for k in range(4)]
        k = splits.SPLITS.index(split)
        assert lacking[k] >= max(lacking) - 1e-9 and k == min(j for j in range(4) if lacking[j] >= max(lacking) - 1e-9)
        given[k] += int(u["size"])


@pytest.mark.parametrize("cell", [4096, 5])
def test_nearest(spark, monkeypatch, cell):
    monkeypatch.setattr(lookups, "CELL", cell)
    r = np.random.default_rng(3)
    rows = [(int(g), i, np.round(p, 1).tolist()) for i, (g, p) in enumerate(zip(r.integers(0, 2, 150), r.random((150, 3)) * (1, 1, 0.2)))]
    frame = spark.createDataFrame([*rows, (None, 900, [0.0, 0.0, 0.0]), (0, 901, None)], "g int, id long, p array<double>")
    got = {(x.id, x.place): (x.other, x.distance) for x in lookups.nearest_within(frame, "g", "id", "p", 0.3, 4).collect()}
    want = {}
    for g, i, p in rows:
        near = sorted((float(np.sqrt(sum((np.array(p) - q) ** 2))), j) for h, j, q in rows if h == g and j != i)
        for place, (d, j) in enumerate([x for x in near if x[0] <= 0.3][:4], 1):
            want[i, place] = (j, pytest.approx(d))
    assert got == want
    assert lookups.nearest_within(frame.limit(0), "g", "id", "p", 0.3, 4).count() == 0


def test_quantile_forest(spark):
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (500, 3))
    y = np.round(x[:, 0] * 3 + r.normal(0, 0.5, 500), 1)
    rows = spark.createDataFrame([(i, a.tolist(), float(t)) for i, (a, t) in enumerate(zip(x, y))], "id long, x array<double>, y double")
    forest = fits.fit_quantile_forest(rows, "x", "y", 5, 10, 1)
    leaf = np.zeros((500, 5), int)
    for v in fits._leaves(forest.model, rows, "x", F.col("id")).collect():
        leaf[v.id, v.tree] = v.leaf
    levels = [0.05, 0.5, 0.9]
    got = {v.id: v["values"] for v in forest.spread(rows, "id", levels).collect()}
    assert len(got) == 500
    for i in range(0, 500, 7):
        weight = np.mean([(leaf[:, t] == leaf[i, t]) / (leaf[:, t] == leaf[i, t]).sum() for t in range(5)], axis=0)
        values = np.unique(y)
        run = np.cumsum([weight[y == v].sum() for v in values])
        assert got[i] == [values[np.argmax(run >= q - 1e-9)] for q in levels]
    assert forest.held.agg(F.max(F.size("targets"))).first()[0] <= 100
    with pytest.raises(ValueError, match="no rows"):
        fits.fit_quantile_forest(rows.limit(0), "x", "y")


@pytest.mark.parametrize("n", [4_000, 32_000])
def test_quantiles_of_equal_features_in_time(spark, n):
    """Rows that no feature parts share their leaves: their quantiles are those of all targets, found once."""
    rows = spark.range(n).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("x"), (F.col("id") * 7919 % n).cast("double").alias("y"))
    began = time.perf_counter()
    forest = fits.fit_quantile_forest(rows, "x", "y", 3)
    found = forest.spread(rows, "id", [0.25, 0.5]).groupBy("values").count().collect()
    assert [(r["values"], r["count"]) for r in found] == [([n / 4 - 1, n / 2 - 1], n)] and time.perf_counter() - began < 40


def test_class_weighted_forest(spark):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (300, 2))
    rows = spark.createDataFrame([(i, a.tolist(), int(a[0] + a[1] > 1.5)) for i, a in enumerate(x)], "id long, x array<double>, y int")
    weights = {w.label: (w.n, w.weight) for w in fits.class_weights(rows, "y").collect()}
    n = sum(a[0] + a[1] > 1.5 for a in x)
    assert weights == {1: (n, pytest.approx(150 / n)), 0: (300 - n, pytest.approx(150 / (300 - n)))}
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = fits.balanced_forest(rows, "x", "y", 10).transform(rows.withColumn("features", array_to_vector("x"))).select("y", F.get(vector_to_array("probability"), 1).alias("s")).collect()
    assert sum((v.s >= 0.5) == bool(v.y) for v in scored) >= 290


def naive_reasons(e, zero, moments, symbols, limits):
    """The rules written out once more over numbers."""
    m, n, out = np.array(moments, float), len(moments), []
    if not np.isfinite(e):
        out.append("energy isn't finite")
    elif abs(e) > 100 * n:
        out.append("energy a site is too large")
    elif np.isfinite(zero) and np.isfinite(m).all() and zero - e > (m * m).sum() / 4 + n / 2:
        out.append("gain is more than exchange allows")
    out += ["a moment isn't finite"] * (not np.isfinite(m).all())
    return out + [f"site {i} {s} is over its limit" for i, s in enumerate(symbols) if s in limits and np.inf > np.linalg.norm(m[i]) > 1.05 * limits[s]]


def test_relaxations(spark):
    r, rows = np.random.default_rng(6), []
    for i in range(60):
        n = int(r.integers(1, 5))
        moments = r.normal(0, 2, (n, 3))
        if i % 9 == 0:
            moments[0, 1] = [np.nan, np.inf][i % 2]
        e = [float(r.normal(0, 3)), float("nan"), float("-inf"), 150.0 * n][int(r.integers(0, 4)) if i % 3 == 0 else 0]
        rows.append((i, e, float(r.normal(0, 6)) if i % 7 else float("inf"), moments.tolist(), r.choice(["Fe", "O", "Mn"], n).tolist(), {"Fe": 2.0, "Mn": 3.5}))
    schema = "id long, energy double, zero_energy double, moments array<array<double>>, symbols array<string>, limits map<string,double>"
    got = {v.id: v for v in checks.relaxation_reasons(spark.createDataFrame(rows, schema)).collect()}
    for i, *rest in rows:
        assert got[i].reasons == naive_reasons(*rest) and got[i].status == ("invalid" if got[i].reasons else "valid")
    gaps = checks.relaxation_reasons(spark.createDataFrame([(1, None, 0.0, [[1.0, 0.0, 0.0]], ["O"], None), (2, 1.0, None, None, None, None), (3, 1.0, 1.0, [[None, 0.0, 0.0]], ["Fe"], {"Fe": 1.0})], schema))
    assert [v.reasons for v in gaps.orderBy("id").collect()] == [["energy isn't finite"], ["a moment isn't finite"], ["a moment isn't finite"]]


def test_formulas(spark):
    parts = [("a", "Fe", 4.0), ("a", "O", 6.0), ("b", "Li", 0.5), ("b", "O", 1.0), ("c", "Cu", 1.0), ("d", "H", None), ("e", "H", 0.0), ("f", "C", 2e9), ("f", "H", 3e9), ("g", "O", 1.0), ("g", "O", 3.0), ("g", "Ti", 2.0)]
    got = {r.k: r.formula for r in features.reduced_formula(spark.createDataFrame(parts, "k string, element string, amount double"), "k").collect()}
    assert got == {"a": "Fe2O3", "b": "Li0.5O", "c": "Cu", "d": None, "e": None, "f": "C2H3", "g": "O2Ti"}


def test_reciprocal_block(spark):
    r = np.random.default_rng(7)
    cells = r.normal(0, 1, (12, 3, 3)) + 4 * np.eye(3)
    frame = spark.createDataFrame([(i, *map(float, c.ravel())) for i, c in enumerate(cells)], "id long, " + ", ".join(f"m{k} double" for k in range(9)))
    axes = [[F.col(f"m{3 * i + j}") for j in range(3)] for i in range(3)]
    for row in features.reciprocal_block(frame, "id", *axes).collect():
        k = 2 * np.pi * np.linalg.inv(cells[row.id]).T
        length = np.linalg.norm(k, axis=1)
        cosine = [k[1] @ k[2] / length[1] / length[2], k[0] @ k[2] / length[0] / length[2], k[0] @ k[1] / length[0] / length[1]]
        metric, s = k.T @ k, np.sort(length)
        e = np.linalg.eigvalsh(metric)
        want = [*length, abs(np.linalg.det(k)), *np.degrees(np.arccos(cosine)), np.trace(metric), np.trace(metric @ metric), np.linalg.det(metric), e[2] / e[0], s[2] / s[0], s[1] / s[0], np.abs(cosine).sum()]
        assert list(row)[1:] == pytest.approx(want, rel=1e-6)


def test_seed_moments_by_hand(spark):
    fe, gd, o = [(3, "d", 6), (4, "s", 2)], [(4, "f", 7), (5, "d", 1), (6, "s", 2)], [(2, "p", 4)]
    rows = [(1, fe, 3.0, 10.0, 5.0), (2, fe, None, 10.0, 4.0), (3, fe, 3.0, 2.0, 1.4), (4, gd, 3.0, 9.0, 6.3), (5, o, -2.0, 9.0, 0.0), (6, fe, 3.0, None, 0.0), (7, fe, -2.0, 10.0, 2.0), (8, fe, 20.0, 10.0, 0.0)]
    frame = spark.createDataFrame(rows, "id long, o array<struct<n:int,shell:string,electrons:int>>, ox double, lim double, want double")
    got = frame.select("want", features.seed_moment(F.col("o"), F.col("ox"), F.col("lim")).alias("m")).collect()
    assert [r.m for r in got] == pytest.approx([r.want for r in got])


def test_records_and_files(spark, tmp_path):
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump([{"id": "a", "x": 1.5}, {"id": "b"}], f)
    assert {(r.id, r.x) for r in readers.json_records(spark, str(tmp_path / "r.json.gz"), "id string, x double").collect()} == {("a", 1.5), ("b", None)}
    (tmp_path / "s").mkdir()
    for name in ("m1.cif", "m.2.cif", "other.txt"):
        (tmp_path / "s" / name).write_text(f"data {name}")
    assert {(r.sample_id, r.text) for r in readers.structures_in_batches(spark, str(tmp_path / "s")).collect()} == {("m1", "data m1.cif"), ("m.2", "data m.2.cif")}
    for k in range(2):
        writers.write_lines(spark.createDataFrame([(k, "é")], "k int, s string"), str(tmp_path / "lines"))
    assert {json.loads(r.value)["k"] for r in spark.read.text(str(tmp_path / "lines")).collect()} == {0, 1}
    (tmp_path / "x").write_bytes(b"abc")
    assert writers.file_digest(str(tmp_path / "x")) == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    (tmp_path / "id_prop.csv").write_text("a, 1\n\nb,2,g\n,,\n")
    assert [r.sample_id for r in readers.sample_ids(spark, str(tmp_path / "id_prop.csv")).collect()] == ["a", "b"]


def test_sealed_snapshots(spark, tmp_path):
    folder = tmp_path / "snap"
    folder.mkdir()
    (folder / "id_prop.csv").write_text("x-1,1.0\nx-2,2.0\n")
    (folder / "x-1.cif").write_text("one")
    header = {"schema_version": 1, "record_id": "r", "snapshot_version": "1", "target": {"name": "y"}, "features_file": None}
    with pytest.raises(checks.DataError, match="samples_without_structure: 1"):
        writers.seal(spark, str(folder), header, ".cif")
    (folder / "x-2.cif").write_text("two")
    writers.seal(spark, str(folder), header, ".cif")
    s = readers.load_snapshot(spark, str(folder), "regression", needs=["structures"])
    assert s.samples.count() == 2 and s.has_structures
    (folder / "x-2.cif").write_text("TWO")
    with pytest.raises(checks.DataError, match="wrong_digests"):
        readers.load_snapshot(spark, str(folder), "regression")


def test_reports_and_systems(spark):
    rows = spark.createDataFrame([("a", "en", "p", "p"), ("a", "en", "q", "p"), ("b", "en", "p", "q")], "system string, lang string, truth string, prediction string")
    found = sorted(compare.systems(rows, ["lang"], "p", ["precision"]).collect())
    assert [(r.system, r.tp, r.fp, r.precision) for r in found] == [("a", 1, 1, 0.5), ("b", 0, 0, 0.0)]
    text = compare.report([r.asDict() for r in found], ["system", "precision"])
    assert text.splitlines() == ["| system | precision |", "|---|---|", "| a | 0.5 |", "| b | 0.0 |"]


def test_batches_are_served(spark):
    from plumbline.plans.models import served

    def make():
        return lambda batch: batch.assign(y=batch["x"] * 2)

    assert sorted(tuple(r) for r in served(spark.createDataFrame([(1,), (2,)], "x long"), make, "x long, y long").collect()) == [(1, 2), (2, 4)]


def test_small_rules(spark):
    names = spark.createDataFrame([("a_b.c-d.qrf.x.v12",), ("A.b.c.d.v1",), (None,)], "s string")
    assert [r[0] for r in names.select(S.release_module(S.release_part(F.col("s"), 2))).collect()] == ["c_d", None, None]
    assert S.runtime_of("a.b.c.d.v1") == "a.b.c"
    one = checks.two_classes(spark.createDataFrame([("a",), ("a",)], "y string"), "y", "b").first()
    assert (one.classes, one.has_positive) == (1, False)
    with pytest.raises(Exception, match="3 finite numbers"):
        features.blocks(spark.createDataFrame([([1.0], [2.0])], "a array<double>, b array<double>"), ["a", "b"], 3).collect()
    with pytest.raises(ValueError, match="needs a value"):
        lookups.grid_product(spark, {"a": [1], "b": []})


def test_scores_and_predictions_that_are_no_numbers(spark):
    """Null and NaN are in no rank, no threshold and no metric."""
    nan = float("nan")
    rows = [(0.9, "a"), (nan, "a"), (0.2, "b"), (None, "b"), (0.1, "b"), (0.5, None), (0.2, "a")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, s double, c string")
    sound = frame.filter("s is not null and not isnan(s) and c is not null")
    positive = F.col("c") == "a"
    for area in (ranking.roc_auc, ranking.pr_auc):
        assert area(frame, [], "s", positive).first() == area(sound, [], "s", positive).first()
    assert ranking.roc_auc(frame, [], "s", positive).first().n_neg == 2
    assert ranking.top_fractions(frame, "s", "id", positive, [0.5, 1.0]).collect() == ranking.top_fractions(sound, "s", "id", positive, [0.5, 1.0]).collect()
    assert sorted(decisions.cuts(frame, "s", positive).collect()) == sorted(decisions.cuts(sound, "s", positive).collect())
    assert decisions.select_threshold(frame, "s", positive, "mcc").first() == decisions.select_threshold(sound, "s", positive, "mcc").first()
    said = spark.createDataFrame([(1.0, 2.0), (3.0, nan), (nan, 1.0), (2.0, 2.0), (None, 1.0)], "truth double, prediction double")
    found = evaluate.regression(said, ["mae", "rmse", "rounded_accuracy", "mean_excess"]).first()
    assert (found.n, found.mae, found.rounded_accuracy, found.mean_excess) == (2, 0.5, 0.5, 0.5)
    assert [r.n for r in evaluate.by_band(said, [2.0], ["mae"]).orderBy("position").collect()] == [1, 1]
    assert decisions.level_scores(said, {0.5: "prediction"}, "truth", "mae").first().n == 2
    ends = spark.createDataFrame([(1.0, 0.0, nan), (2.0, 1.0, 1.5), (5.0, 4.0, 6.0)], "y double, lo double, hi double")
    assert decisions.conformal_correction(ends, "y", "lo", "hi", 0.9).first().n == 2


def test_table_rows_and_their_lines(spark):
    text = ["|---|", "a | b", "- | -", "```", "|---|", "```", ":--:|", "---", "| - x |", "\t|--|\t", None, "  ~~~", "|--|"]
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(text)] + [("e", 0, "plain")], "doc string, at int, line string")
    found = {r.doc: (r.tables, r.lines) for r in checks.tables_outside_fences(lines, "doc", "at", "line").collect()}
    assert found == {"d": (4, [0, 2, 6, 9]), "e": (0, [])}


def test_contracts_of_sites_and_species(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], {"Fe": 2.0}, '{"Fe": 2, "O": -1.5}'), (2, [1.0], {"fe": 1.0}, "[1]"), (3, None, None, None), (4, [], {}, '{"Iron": 2}')], "n int, sites array<double>, species map<string,double>, said string")
    outside = lambda c, kind, length=None: checks.target_domain(frame, c, kind, length=length).first().outside
    assert (outside("sites", "per_site"), outside("sites", "per_site", F.lit(2)), outside("species", "per_species"), outside("said", "per_species")) == (1, 3, 2, 3)


def test_composition_block(spark):
    """Against one composition at a time."""
    table = spark.createDataFrame([("Fe", 26.0, 2.0, 6.0), ("O", 8.0, 2.0, 0.0), ("Xe", None, 0.0, 0.0)], "element string, z double, s double, d double")
    parts = spark.createDataFrame([("a", "Fe", 2.0), ("a", "O", 1.0), ("a", "O", 2.0), ("b", "O", 1.0), ("b", "Fe", 1.0), ("c", "Xe", 1.0), ("d", "Zz", 1.0), ("e", "O", 0.0), ("f", "O", None)], "k string, element string, amount double")
    rows = parts.select("k").distinct().unionByName(spark.createDataFrame([("g",)], "k string"))
    got = {r.k: r for r in features.composition_block(rows, "k", parts, table, ["z"], ["s", "d"]).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.norm_0, a.norm_2, a.z_minimum, a.z_maximum, a.z_range, a.z_mode) == (2, pytest.approx(np.hypot(0.4, 0.6)), 8, 26, 18, 8)
    assert a.z_mean == pytest.approx(0.4 * 26 + 0.6 * 8) and a.z_avg_dev == pytest.approx(0.4 * abs(26 - a.z_mean) + 0.6 * abs(8 - a.z_mean))
    assert (a.s_avg, a.d_avg, a.s_frac) == (pytest.approx(2), pytest.approx(2.4), pytest.approx(2 / 4.4)) and b.z_mode == 8
    assert (c.norm_0, c.z_mean, c.s_frac) == (1, None, 0) and all(got[k].norm_0 is None and got[k].s_avg is None for k in "defg")
