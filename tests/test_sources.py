"""Snapshots, features, splits and bundles: what is good is read, what is not is told."""

import hashlib
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks
from plumbline.plans import protocol
from plumbline.sources import readers, writers


def snapshot(path, rows, extra=None, **header):
    path.mkdir(exist_ok=True)
    (path / "id_prop.csv").write_text("\n".join(rows) + "\n")
    for name, text in (extra or {}).items():
        (path / name).write_text(text)
    files = [{"name": f.name, "size_bytes": f.stat().st_size, "sha256": hashlib.sha256(f.read_bytes()).hexdigest()} for f in sorted(path.iterdir()) if f.name != "manifest.json"]
    base = {"schema_version": 1, "record_id": "r", "snapshot_version": "1", "target": {"name": "y", "contract": "c", "units": "u"}, "features_file": None, "structure_suffix": None}
    (path / "manifest.json").write_text(json.dumps(base | header | {"files": files}))
    return str(path)


GOOD = ["a-1, 1.5, g1", "", "a-2,2,g1", ",,", "a-3,-3e1,g2"]


def test_a_good_snapshot(spark, tmp_path):
    s = readers.load_snapshot(spark, snapshot(tmp_path / "s", GOOD), "regression", ("y", "c", "u"), ["groups"])
    assert sorted(tuple(r) for r in s.samples.collect()) == [("a-1", 1.5, None, "g1"), ("a-2", 2.0, None, "g1"), ("a-3", -30.0, None, "g2")]
    assert s.has_groups and not s.has_features and len(s.digest) == 64


def test_derived_classes(spark, tmp_path):
    s = readers.load_snapshot(spark, snapshot(tmp_path / "s", GOOD), "classification", threshold=1.5)
    rows = readers.typed_samples(readers.sample_lines(spark, str(tmp_path / "s" / "id_prop.csv")), "classification", 1.5, "big", "small")
    assert {r.sample_id: r.target_label for r in rows.collect()} == {"a-1": "big", "a-2": "big", "a-3": "small"}
    assert s.samples.count() == 3


@pytest.mark.parametrize(
    "rows, said",
    [
        (["a,1", "a,2"], "repeated_ids"), (["a,x"], "bad_targets"), (["a,nan"], "bad_targets"), (["a,"], "bad_targets"), (["a,1,g,z"], "wrong_fields"),
        (["a,1,"], "empty_groups"), (["a/b,1"], "unsafe_ids"), (["..,1"], "unsafe_ids"), (["0,1", "1,1"], "row positions"), (["1,1", "2,1"], "row positions"), ([""], "no_rows"),
    ],
)
def test_unusable_rows(spark, tmp_path, rows, said):
    with pytest.raises(checks.DataError, match=said):
        readers.load_snapshot(spark, snapshot(tmp_path / "s", rows), "regression")


def test_tampering(spark, tmp_path):
    for change, said in (("alter", "wrong_digests"), ("grow", "wrong_sizes"), ("add", "unlisted_files"), ("drop", "stale_entries")):
        where = tmp_path / change
        path = snapshot(where, GOOD, {"notes.txt": "abc"})
        {"alter": lambda: (where / "notes.txt").write_text("abd"), "grow": lambda: (where / "notes.txt").write_text("abcd"), "add": lambda: (where / "more.txt").write_text("x"), "drop": lambda: (where / "notes.txt").unlink()}[change]()
        with pytest.raises(checks.DataError, match=said):
            readers.load_snapshot(spark, path, "regression")
    with pytest.raises(checks.DataError, match="unknown manifest keys"):
        readers.load_snapshot(spark, snapshot(tmp_path / "k", GOOD, odd=1), "regression")
    with pytest.raises(checks.DataError, match="target"):
        readers.load_snapshot(spark, snapshot(tmp_path / "t", GOOD), "regression", ("y", "c", "other"))
    with pytest.raises(checks.DataError, match="no features"):
        readers.load_snapshot(spark, snapshot(tmp_path / "n", GOOD), "regression", needs=["features"])


def test_features(spark, tmp_path):
    (tmp_path / "f.csv").write_text("sample_id,x1,x2\na,1,2\nb,3,inf\n")
    path = str(tmp_path / "f.csv")
    assert [tuple(r) for r in readers.feature_table(spark, path, ["x1"]).orderBy("sample_id").collect()] == [("a", 1.0), ("b", 3.0)]
    with pytest.raises(Exception, match="x2 of b"):
        readers.feature_table(spark, path, ["x2"]).collect()
    with pytest.raises(checks.DataError, match="no columns"):
        readers.feature_table(spark, path, ["x9"])


def test_lookup_is_strict(spark):
    from plumbline.operators.lookups import lookup

    a = spark.createDataFrame([("a",), ("b",)], "id string")
    f = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("z", 9.0)], "id string, x double")
    assert sorted(tuple(r) for r in lookup(a, f, "id", ["x"]).collect()) == [("a", 1.0), ("b", 2.0)]
    with pytest.raises(Exception, match="no features for b"):
        lookup(a, f.filter("id <> 'b'"), "id", ["x"]).collect()
    with pytest.raises(Exception, match="repeated features for a"):
        lookup(a, f.union(f.filter("id = 'a'")), "id", ["x"]).collect()


def test_archives(spark, tmp_path):
    def archive(name, members):
        with tarfile.open(tmp_path / name, "w:gz") as t:
            for m in members:
                info = tarfile.TarInfo(m)
                info.size = 3
                t.addfile(info, io.BytesIO(b"abc"))
        return str(tmp_path / name)

    got = readers.archive_members(spark, archive("good.tar.gz", ["CIF_files/a.cif", "CIF_files/b.cif"]), "CIF_files").collect()
    assert sorted((r.sample_id, bytes(r.content)) for r in got) == [("a", b"abc"), ("b", b"abc")]
    for bad in ("../x.cif", "/x.cif", "CIF_files/x.txt", "CIF_files/d/x.cif"):
        with pytest.raises(Exception, match="unexpected archive member"):
            readers.archive_members(spark, archive("bad.tar.gz", [bad]), "CIF_files").collect()


def test_summaries(spark, tmp_path):
    (tmp_path / "s.csv").write_text('source_db_id,k_index,k_dist_interval,k_mesh\na,3,"[1.0, 0.5)","(4, 4, 4)"\n')
    assert [tuple(r) for r in readers.convergence_summary(spark, str(tmp_path / "s.csv")).collect()] == [("a", 3)]
    (tmp_path / "s.csv").write_text('source_db_id,k_index,k_dist_interval,k_mesh\na,-3,"[1.0, 0.5)","(4, 4, 4)"\n')
    with pytest.raises(checks.DataError, match="bad_targets"):
        readers.convergence_summary(spark, str(tmp_path / "s.csv"))


def test_bundles(spark, tmp_path):
    out = tmp_path / "run"
    writers.prepare_directory(spark, str(out))
    (out / "metrics.json").write_text("{}")
    (out / "run.json").write_text('{"when": 1}')
    first = writers.write_manifest(spark, str(out))
    (out / "run.json").write_text('{"when": 2}')
    second = writers.write_manifest(spark, str(out))
    assert first["deterministic_digest"] == second["deterministic_digest"] and first["files"] != second["files"]
    assert first["non_deterministic_files"] == ["run.json"]
    line = f"metrics.json:{hashlib.sha256(b'{}').hexdigest()}\n"
    assert first["deterministic_digest"] == hashlib.sha256(line.encode()).hexdigest()
    with pytest.raises(FileExistsError):
        writers.prepare_directory(spark, str(out))
    writers.prepare_directory(spark, str(out), overwrite=True)
    assert [p.name for p in out.iterdir()] == [writers.MARKER]


def test_written_splits_are_read_again(spark, tmp_path):
    given = spark.createDataFrame([("b", "test"), ("a", "train")], "sample_id string, split string")
    writers.write_splits(given, str(tmp_path / "splits"))
    assert [tuple(r) for r in readers.read_splits(spark, str(tmp_path / "splits")).collect()] == [("a", "train"), ("b", "test")]
    preds = given.withColumn("source", F.lit("model")).withColumn("truth", F.lit(1.0)).withColumn("lower", F.lit(None).cast("double"))
    writers.write_predictions(preds, str(tmp_path / "preds"))
    text = spark.read.text(str(tmp_path / "preds")).collect()
    assert [r[0] for r in text] == ["sample_id,split,source,truth,lower", "a,train,model,1.0,", "b,test,model,1.0,"]


CONFIG = """
name = "shape.value.ridge.synthetic.v1"
model = "linear_regression"
features = ["x1", "x2"]
[dataset]
task = "regression"
target = "y"
contract = "c"
units = "u"
[split]
seed = 42
[evaluation]
metrics = ["mae", "rmse"]
primary = "mae"
"""


def test_configurations():
    p = protocol.parse(CONFIG)
    assert p.split.ratios == (0.7, 0.1, 0.1, 0.1) and p.resolved()["evaluation"]["decision_rule"] is None
    for old, new, said in (
        ('primary = "mae"', 'primary = "r2"', "primary"), ("seed = 42", "seed = -1", "seed"), ("seed = 42", "speed = 1", "unknown keys"),
        ('"rmse"]', '"f1"]', "metrics of this task"), ("v1", "one", "five dotted parts"), ('["x1", "x2"]', '["x1", "x1"]', "features"),
        ('primary = "mae"', 'primary = "mae"\nmin_recall = 0.9', "recall floor"), ('primary = "mae"', 'primary = "mae"\nbands = [3, 2]', "increase"),
    ):
        with pytest.raises(protocol.ConfigError, match=said):
            protocol.parse(CONFIG.replace(old, new, 1))


def test_a_run_from_a_configuration(spark):
    from plumbline.plans.training import execute

    data = spark.createDataFrame([(f"s{i}", float(i % 5), float(i % 3), 2.0 * (i % 5) - i % 3 + 3) for i in range(60)], "sample_id string, x1 double, x2 double, target double")
    run = execute(protocol.parse(CONFIG), data)
    found = {(r.source, r.split): r.mae for r in run.metrics.collect()}
    assert len(found) == 8 and all(v < 1e-9 for (s, _), v in found.items() if s == "model") and found["baseline", "test"] > 0.1
    text = CONFIG.replace('"regression"', '"classification"').replace("linear", "logistic").replace('["mae", "rmse"]', '["accuracy", "roc_auc"]').replace('"mae"', '"accuracy"')
    text = text.replace('primary = "accuracy"', 'primary = "accuracy"\nthreshold_metric = "f1"').replace("[dataset]", "[parameters]\nsteps = 30\nrate = 0.5\n[dataset]")
    run = execute(protocol.parse(text), data.withColumn("target", F.when(F.col("x1") >= 2, "yes").otherwise("no")))
    found = {(r.source, r.split): r.accuracy for r in run.metrics.collect()}
    assert found["model", "test"] == 1.0 and run.threshold is not None


def test_names_are_registered_once():
    from plumbline.plans import models

    with pytest.raises(ValueError, match="there is a trainer"):
        models.register("trainer", "linear_regression")(lambda p, c: None)
    with pytest.raises(ValueError, match="no trainer"):
        models.trainer("nothing")


def test_streams_add_up(spark, sf):
    from plumbline.streaming.metrics import windowed_sums

    rows = spark.read.parquet(f"{sf}/events.parquet").select("ts", F.col("event_type").alias("source"), F.col("value").alias("truth"), (F.col("value") * 0.9).alias("prediction"))
    batch = windowed_sums(rows, "ts", "1 day", "1 day")
    stream = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    shaped = stream.select("ts", F.col("event_type").alias("source"), F.col("value").alias("truth"), (F.col("value") * 0.9).alias("prediction"))
    query = windowed_sums(shaped, "ts", "1 day", "1 day").writeStream.format("memory").queryName("sums").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("sums").agg(F.sum("n"), F.round(F.sum("abs_error"), 4)).first() == batch.agg(F.sum("n"), F.round(F.sum("abs_error"), 4)).first()
