"""Configurations run end to end: each trainer, its decisions, the bundle, and the model that is served from it."""

import json
import tomllib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks
from plumbline.plans import models, protocol
from plumbline.plans.training import execute, write_bundle


def config(name, model, task, metrics, evaluation="", parameters="", method="random", more=""):
    return f"""
name = "{name}"
model = "{model}"
features = ["x1", "x2"]
[parameters]
{parameters}
[dataset]
task = "{task}"
target = "y"
contract = "c"
units = "u"
{more}
[split]
method = "{method}"
ratios = [0.4, 0.2, 0.2, 0.2]
seed = 3
[evaluation]
metrics = {json.dumps(metrics)}
primary = "{metrics[0]}"
{evaluation}
"""


@pytest.fixture(scope="module")
def samples(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 8, (400, 2))
    y = x[:, 0] * 2 + (x[:, 1] > 3) * 6 + r.integers(0, 3, 400)
    rows = [(f"s{i:03d}", f"g{i % 40}", float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "sample_id string, group string, x1 double, x2 double, target double").cache()


QRF = "k_points.k_index.qrf.drawn.v1"
SEARCH = "trees = 5\nquantiles = [0.1, 0.5, 0.9]\n[parameters.search]\nmin_samples_leaf = [5, 60]"
DECIDED = 'decision_metric = "mae"\nmax_underprediction = 0.3\n'
METRICS = ["mae", "rmse", "r2", "interval_coverage", "mean_interval_width", "pinball", "mean_excess"]


def test_quantile_run(spark, samples, tmp_path):
    text = config(QRF, protocol.QUANTILE, "regression", METRICS, "bands = [6, 14]", SEARCH, "group")
    run = execute(protocol.parse(text), samples)
    s = run.model.settings
    assert [t["min_samples_leaf"] for t in s["trials"]] == [5, 60] and s["selected"]["min_samples_leaf"] == min(s["trials"], key=lambda t: t["validation_pinball"])["min_samples_leaf"]
    found = {(r.source, r.split): r for r in run.metrics.collect()}
    assert len(found) == 8 and found["model", "test"].mae < found["baseline", "test"].mae and found["baseline", "test"].pinball is None
    assert found["model", "calibration"].interval_coverage >= 0.8 and found["model", "test"].mean_interval_width > 0
    preds = run.predictions.filter("source = 'model'")
    assert preds.filter("not (lower <= prediction and prediction <= upper)").count() == 0 and preds.count() == 400
    assert {r.band for r in run.bands.collect()} == {"<6", "[6,14)", ">=14"}
    groups = run.assignment.join(samples.select("sample_id", "group"), "sample_id").groupBy("group").agg(F.count_distinct("split").alias("n"))
    assert groups.filter("n > 1").count() == 0
    # the same run again gives the same bundle but for its provenance, and what is served predicts the same
    first = write_bundle(run, str(tmp_path / "a"), "one")
    again = execute(run.protocol, samples, run.assignment)
    second = write_bundle(again, str(tmp_path / "b"), "two", reused_splits=True)
    files = {f["name"] for f in first["manifest"]["files"]}
    assert files == {"protocol.toml", "dataset.json", "splits.csv", "predictions.csv", "metrics.json", "environment.json", "run.json", "model.json"}
    assert (tmp_path / "a" / "predictions.csv").read_text() == (tmp_path / "b" / "predictions.csv").read_text()
    kept = protocol.parse((tmp_path / "a" / "protocol.toml").read_text())
    assert kept == run.protocol and tomllib.loads((tmp_path / "a" / "protocol.toml").read_text())["name"] == QRF
    record = json.loads((tmp_path / "a" / "run.json").read_text())
    assert record["started_at"].endswith("+00:00") and record["run_id"] == "one" and not record["splits_reused"]
    loaded = models.load_model(spark, str(tmp_path / "a"), ("y", "c", "u"))
    rows = samples.limit(50)
    a, b = (sorted((r.sample_id, r.lower, r.value, r.upper, r.published) for r in m.apply(rows).collect()) for m in (loaded, run.model))
    assert a == b and all(v == p for _, _, v, _, p in a)
    run.close()


@pytest.mark.parametrize("rule,most", [("quantile", 0.12), ("offset", 0.12), ("quantile_by_band", 0.12)])
def test_decisions(spark, samples, tmp_path, rule, most):
    bands = "" if rule == "quantile" else "decision_bands = [8]\n"
    decided = DECIDED.replace("0.3", str(most))
    metric = decided.replace("mae", "mean_excess") if rule == "offset" else decided
    parameters = "trees = 5\ndecision_levels = [0.5, 0.7, 0.9]"
    run = execute(protocol.parse(config(QRF, protocol.QUANTILE, "regression", ["mae"], f'decision_rule = "{rule}"\n{metric}{bands}', parameters)), samples)
    d = run.model.settings["decision"]
    rows = run.model.levels(samples.join(run.assignment, "sample_id").filter("split = 'validation'")).collect()
    rate = lambda q, some: np.mean([np.floor(r[models.level_name(q)] + 0.5) < r.target for r in some])
    parts = [rows] if rule != "quantile_by_band" else [[r for r in rows if (np.floor(r[models.level_name(0.5)] + 0.5) < 8) == low] for low in (True, False)]
    chosen = [d["level"]] if rule != "quantile_by_band" else [b["level"] for b in d["bands"]]
    for q, some in zip(chosen, parts):
        assert rate(q, some) <= most
        cost = {x: np.mean([abs(r.target - r[models.level_name(x)]) if rule != "offset" else np.floor(r[models.level_name(x)] + 0.5) - r.target for r in some]) for x in (0.5, 0.7, 0.9) if rate(x, some) <= most}
        assert cost[q] <= min(cost.values()) + 1e-9 or rule == "offset"
    out = run.model.apply(samples).collect()
    if rule == "offset":
        offsets = [b["offset"] for b in d["bands"]]
        held = {r.sample_id: r[models.level_name(d["level"])] for r in run.model.levels(samples).collect()}
        assert all(r.published == np.floor(held[r.sample_id] + 0.5) + offsets[int(np.floor(held[r.sample_id] + 0.5) >= 8)] for r in out)
    assert all(r.published is not None for r in out)
    # what is published is what is predicted, written and scored; no rule moves the median, which tells the loss of its level
    said = run.predictions.filter("source = 'model'").collect()
    assert {r.sample_id: r.prediction for r in said} == {r.sample_id: r.published for r in out} != {r.sample_id: r.value for r in out}
    assert {r.sample_id: r.median for r in said} == {r.sample_id: r.value for r in out}
    write_bundle(run, str(tmp_path / "b"), "one")
    lines = (tmp_path / "b" / "predictions.csv").read_text().splitlines()
    assert lines[0] == "sample_id,split,source,truth,prediction,lower,upper"
    written = {x[0]: float(x[4]) for x in (line.split(",") for line in lines[1:]) if x[2] == "model"}
    assert written == pytest.approx({r.sample_id: r.published for r in out})
    for m in run.metrics.filter("source = 'model'").collect():
        some = [(r.truth, r.prediction) for r in said if r.split == m.split]
        assert m.mae == pytest.approx(np.mean([abs(y - p) for y, p in some]))
    assert json.loads((tmp_path / "b" / "metrics.json").read_text())["decision"]["rule"] == rule


def test_screen_run(spark, samples, tmp_path):
    text = config(
        "k_points.k_index.screen.drawn.v1", "dense_mesh_screen", "classification", ["pr_auc", "roc_auc", "mcc", "recall"], 'threshold_metric = "mcc"\nmin_recall = 0.8\npositive = "dense"', "trees = 8",
        more='[dataset.derive]\nthreshold = 14.0\npositive = "dense"\nnegative = "sparse"',
    )
    run = execute(protocol.parse(text), samples)
    found = {(r.source, r.split): r for r in run.metrics.collect()}
    assert found["model", "validation"].recall >= 0.8 and found["model", "test"].roc_auc > 0.9 and found["baseline", "test"].roc_auc == 0.5
    base = run.predictions.filter("source = 'baseline'").first()
    assert base.prediction == "sparse" and 0 < base.score < 0.5
    assert run.predictions.filter(f"source = 'model' and (prediction = 'dense') <> (score >= {run.threshold!r})").count() == 0
    write_bundle(run, str(tmp_path / "s"), "one")
    loaded = models.load_model(spark, str(tmp_path / "s"))
    told = models.read_record(spark, str(tmp_path / "s"))["model"]
    assert told["decision"] == loaded.settings["decision"] and told["decision"]["selected_on"] == "validation" and told["grown"]["depth"] > 5
    held = sorted(((r.score, r.truth == "dense") for r in run.predictions.filter("source = 'model' and split = 'validation'").collect()), reverse=True)
    assert told["decision"]["positive_rate"] == pytest.approx(np.mean([y for _, y in held]))
    assert [f["fraction"] for f in told["decision"]["fractions"]] == list(models.REPORTED_FRACTIONS)
    assert all(f["taken"] == max(1, round(f["fraction"] * len(held))) and 0 <= f["hits"] <= f["taken"] for f in told["decision"]["fractions"])
    a, b = (sorted((r.sample_id, r.score) for r in m.apply(samples).collect()) for m in (loaded, run.model))
    assert a == b


@pytest.mark.parametrize("model,task,metrics", [("linear_regression", "regression", ["mae"]), ("logistic_regression", "classification", ["accuracy"])])
def test_reference_models_are_served(spark, samples, tmp_path, model, task, metrics):
    rows = samples if task == "regression" else samples.withColumn("target", F.when(F.col("target") > 9, "yes").otherwise("no"))
    run = execute(protocol.parse(config("a.b.linear.drawn.v1", model, task, metrics, parameters="" if task == "regression" else "steps = 20")), rows)
    write_bundle(run, str(tmp_path / "m"), "one")
    loaded, column = models.load_model(spark, str(tmp_path / "m"), ("y", "c", "u")), "value" if task == "regression" else "score"
    a, b = (sorted((r.sample_id, r[column]) for r in m.apply(rows).collect()) for m in (loaded, run.model))
    assert a == b


def test_records_are_checked(spark, samples, tmp_path):
    run = execute(protocol.parse(config(QRF, protocol.QUANTILE, "regression", ["mae"], parameters="trees = 2")), samples)
    write_bundle(run, str(tmp_path / "m"), "one")
    good = models.read_record(spark, str(tmp_path / "m"))
    for change, said in (
        ({"record_version": 2}, "version"), ({"role": "oracle"}, "role"), ({"role": "feature_extractor"}, "no question"), ({"features": ["x2", "x1"]}, "order"), ({"runtime": "a.b.c"}, "claim"),
        ({"model": good["model"] | {"trainer": "none"}}, "serves"), ({"model": good["model"] | {"mean_width": -1}}, "width"),
    ):
        with pytest.raises(ValueError, match=said):
            models.check_record(good | change)
    with pytest.raises(ValueError, match="in eV"):
        models.check_record(good, ("y", "c", "eV"))
    with pytest.raises(ValueError, match="lacks"):
        models.check_record({k: v for k, v in good.items() if k != "artifacts"})
    with pytest.raises(ValueError, match="isn't what"):
        models.load_model(spark, str(tmp_path / "m"), artifacts={"forest": "0" * 64})
    # files exchanged between folders keep all bytes there, but aren't the model any more
    a, b = (next(p for p in (tmp_path / "m" / "forest" / f).rglob("part-*")) for f in ("metadata", "treesMetadata"))
    held = a.read_bytes(), b.read_bytes()
    for p, content in ((a, held[1]), (b, held[0])):
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
        p.write_bytes(content)
    with pytest.raises(ValueError, match="forest isn't what"):
        models.load_model(spark, str(tmp_path / "m"))
    for p, content in ((a, held[0]), (b, held[1])):
        p.write_bytes(content)
    part = next(p for p in (tmp_path / "m" / "leaves").iterdir() if p.name.startswith("part-"))
    (part.parent / f".{part.name}.crc").unlink()
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ValueError, match="leaves isn't what"):
        models.load_model(spark, str(tmp_path / "m"))


@pytest.mark.parametrize(
    "change,said",
    [
        (("[parameters]", "[parameters]\ndepth = 3"), "knows"), ((QRF, "k_points.k_index.screen.x.v1"), "third part"), (('"mae"', '"pinball"'), None), (("[0.4, 0.2, 0.2, 0.2]", "[0.8, 0.0, 0.0, 0.2]"), "calibration"),
        (("[evaluation]", '[evaluation]\ndecision_metric = "mae"'), "rule and a metric"), (("[evaluation]", '[evaluation]\ndecision_metric = "mae"\ndecision_rule = "quantile"'), "levels"),
        (("[evaluation]", '[evaluation]\ndecision_metric = "mae"\ndecision_rule = "offset"\ndecision_bands = [3]'), "whole numbers"), (("[evaluation]", '[evaluation]\npositive = "a"'), "for classes"),
        (("[parameters]", "[parameters]\nquantiles = [0.5, 0.1, 0.9]"), "quantiles"), (("[parameters]", "[parameters]\nsearch = {depth = [1]}"), "search"), ((protocol.QUANTILE, "cgcnn"), "trainers"), ((f'"{protocol.QUANTILE}"', '"logistic_regression"'), "is for"),
    ],
)
def test_what_cannot_run_is_refused(change, said):
    text = config(QRF, protocol.QUANTILE, "regression", ["mae"]).replace(*change)
    if said is None:
        assert protocol.parse(text).evaluation.metrics == ("pinball",)
    else:
        with pytest.raises(protocol.ConfigError, match=said):
            protocol.parse(text)


def test_one_class_is_refused(spark, samples):
    text = config("a.b.c.d.v1", "logistic_regression", "classification", ["accuracy"], 'positive = "yes"')
    with pytest.raises(checks.DataError, match="two classes"):
        execute(protocol.parse(text), samples.withColumn("target", F.lit("no")))
