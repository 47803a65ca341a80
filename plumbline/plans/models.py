"""Named trainers, feature contracts and predictors; fitted models, their records, and what serves them.

A fitted model has `apply(rows)`, which adds its columns to rows with the features, `describe()`, its record,
and `save(spark, directory)`, what the record refers to. Featurizers and networks that live outside this engine
come in by `served`."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.metrics import INTEGER, half_up
from ..operators import decisions, evaluate, fits, lookups, networks, ranking
from ..sources import writers
from ..sources.readers import file_listing
from .protocol import QUANTILE, TRAINERS

_REGISTRIES: dict[str, dict[str, Callable]] = {"trainer": {}, "features": {}, "predictor": {}}


def register(kind: str, name: str):
    """Registers a function under a name, which must be free."""

    def add(function: Callable) -> Callable:
        if name in _REGISTRIES[kind]:
            raise ValueError(f"there is a {kind} named {name}")
        _REGISTRIES[kind][name] = function
        return function

    return add


def _named(kind: str, name: str) -> Callable:
    try:
        return _REGISTRIES[kind][name]
    except KeyError:
        raise ValueError(f"no {kind} is named {name}; there are {sorted(_REGISTRIES[kind])}") from None


def trainer(name: str) -> Callable:
    """(protocol, context) -> fitted model."""
    return _named("trainer", name)


def feature_contract(name: str) -> Callable:
    """(samples, ...) -> (sample_id, features); must not look from one sample at another."""
    return _named("features", name)


def predictor(name: str) -> Callable:
    """(spark, record, directory) -> fitted model."""
    return _named("predictor", name)


# The version of records, what a record may be, and its file.
RECORD_VERSION, ROLES, RECORD = 1, ("model", "feature_extractor"), "model.json"


@dataclass(frozen=True)
class Linear:
    """A linear score, or with `positive` a probability of that class."""

    model: fits.LinearModel
    trainer: str
    positive: str | None = None

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", self.model.probability()) if self.positive is not None else rows.withColumn("value", self.model.score())

    def describe(self) -> dict:
        m = self.model
        return {
            "trainer": self.trainer, "positive": self.positive, "columns": list(m.standard.columns), "means": list(m.standard.means),
            "deviations": list(m.standard.deviations), "weights": list(m.weights), "bias": m.bias,
        }

    def save(self, spark: SparkSession, directory: str) -> dict:
        return {}


@register("trainer", "linear_regression")
def _linear(protocol, seen):
    return Linear(fits.ridge(seen.train, protocol.features, "target", protocol.parameters.get("l2", 0.0)), "linear_regression")


@register("trainer", "logistic_regression")
def _logistic(protocol, seen):
    positive, q = protocol.evaluation.positive or evaluate.default_positive(seen.train, "target"), protocol.parameters
    target = (F.col("target") == positive).cast("double")
    return Linear(fits.logistic(seen.train, protocol.features, target, q.get("steps", 500), q.get("rate", 0.1), q.get("l2", 0.0)), "logistic_regression", positive)


@register("predictor", "linear_regression")
@register("predictor", "logistic_regression")
def _load_linear(spark: SparkSession, record: dict, directory: str) -> Linear:
    m = record["model"]
    standard = fits.Standardizer(tuple(m["columns"]), tuple(m["means"]), tuple(m["deviations"]))
    return Linear(fits.LinearModel(standard, tuple(m["weights"]), m["bias"]), m["trainer"], m["positive"])


def _arrayed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumn("_x", F.array(*(F.col(c).cast("double") for c in columns)))


@dataclass(frozen=True)
class Quantile:
    """A forest's three quantiles, its interval calibrated, and the value that its rule publishes: the median without one.

    `apply` adds lower, value (the median, which no rule moves), upper, wide and published, which is the prediction."""

    forest: fits.QuantileForest
    columns: tuple[str, ...]
    settings: dict

    def levels(self, rows: DataFrame) -> DataFrame:
        return quantile_columns(self.forest, rows, self.columns, self.settings["levels"])

    def apply(self, rows: DataFrame) -> DataFrame:
        s = self.settings
        low, mid, high = (F.col(level_name(q)) for q in s["quantiles"])
        lower, upper = S.calibrated(low, mid, high, s["correction"])
        out = self.levels(rows).withColumns({"lower": lower, "value": mid, "upper": upper})
        out = out.withColumns({"wide": S.wide_interval(F.col("lower"), F.col("upper"), s["mean_width"]), "published": _published(s.get("decision"))})
        return out.drop(*map(level_name, s["levels"]))

    def describe(self) -> dict:
        return {"trainer": QUANTILE, "columns": list(self.columns), "trees": self.forest.trees, **self.settings}

    def save(self, spark: SparkSession, directory: str) -> dict:
        self.forest.model.write().overwrite().save(f"{directory}/forest")
        self.forest.held.write.mode("overwrite").parquet(f"{directory}/leaves")
        return {name: tree_digest(spark, f"{directory}/{name}") for name in ("forest", "leaves")}


def level_name(level: float) -> str:
    return f"_q{level:g}".replace(".", "_")


def quantile_columns(forest: fits.QuantileForest, rows: DataFrame, columns: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """`rows` (sample_id, columns...) with a column for each level."""
    found = forest.spread(_arrayed(rows, columns), "sample_id", levels)
    named = found.select("sample_id", *(F.get("values", i).alias(level_name(q)) for i, q in enumerate(levels)))
    return rows.join(named, "sample_id")


def _published(decision: dict | None):
    """The column that a decision publishes, of columns of levels; the median where nothing was decided."""
    if not decision:
        return F.col(level_name(0.5))
    if decision["rule"] == "quantile_by_band":
        levels = {b["band"]: F.col(level_name(b["level"])) for b in decision["bands"]}
        return S.published_by_band(F.col(level_name(0.5)), decision["edges"], levels)
    value = F.col(level_name(decision["level"]))
    if decision["rule"] == "offset":
        uppers = [*decision["edges"], None]
        return S.published(value, [(u, b["offset"]) for u, b in zip(uppers, decision["bands"])])
    return half_up(value) if decision["whole"] else value


def _decide(protocol, rows: DataFrame) -> dict | None:
    """What to publish, chosen on validation rows with a column for each level."""
    e = protocol.evaluation
    if e.decision_rule is None:
        return None
    levels = {q: level_name(q) for q in sorted(set(protocol.parameters["decision_levels"]))}
    told = {"rule": e.decision_rule, "metric": e.decision_metric, "max_underprediction": e.max_underprediction, "selected_on": "validation"}
    if e.decision_rule == "quantile_by_band":
        found = decisions.level_by_band(rows, levels, "target", level_name(0.5), e.decision_bands, e.decision_metric, e.max_underprediction).collect()
        order = {label: i for i, (*_, label) in enumerate(S.band_edges(e.decision_bands))}
        bands = [r.asDict() for r in sorted(found, key=lambda r: order[r["band"]])]
        if any(b["level"] is None for b in bands):
            raise ValueError("no level keeps underpredictions to the ceiling in every band")
        return told | {"edges": list(e.decision_bands), "bands": bands}
    best = decisions.select_level(rows, levels, "target", e.decision_metric, e.max_underprediction).first()
    if best is None or best["level"] is None:
        raise ValueError("no level keeps underpredictions to the ceiling")
    told |= {"level": best["level"], "value": best["value"], "rate": best["rate"], "whole": e.decision_metric in INTEGER}
    if e.decision_rule == "offset":
        found = decisions.band_offsets(rows, "target", level_name(best["level"]), e.decision_bands, e.max_underprediction).orderBy("position").collect()
        told |= {"edges": list(e.decision_bands), "bands": [r.asDict() for r in found]}
    return told


@register("trainer", QUANTILE)
def _quantile(protocol, seen):
    """Every candidate is fitted on train and scored on validation; the first best is kept and calibrated."""
    q, spark = protocol.parameters, seen.train.sparkSession
    quantiles = [float(x) for x in q.get("quantiles", (0.05, 0.5, 0.95))]
    levels = sorted({*quantiles, *map(float, q.get("decision_levels", ()))})
    search = {"min_samples_leaf": [fits.LEAF], "trees": [q.get("trees", 100)]} | q.get("search", {})
    candidates = [r.asDict() for r in lookups.grid_product(spark, search).orderBy("position").drop("position").collect()]
    train, trials, best = _arrayed(seen.train, protocol.features), [], None
    for candidate in candidates:
        forest = fits.fit_quantile_forest(train, "_x", "target", candidate["trees"], candidate["min_samples_leaf"], q.get("seed", 0))
        score = None
        if len(candidates) > 1:
            found = quantile_columns(forest, seen.validation, protocol.features, quantiles)
            named = found.select(F.col("target").alias("truth"), *(F.col(level_name(x)).alias(n) for x, n in zip(quantiles, ("lower", "median", "upper"))))
            score = evaluate.intervals(named, levels=quantiles).first()["pinball_mean"]
        trials.append(candidate | {"validation_pinball": score})
        if best is None or score < best[0]:
            best = score, candidate, forest
    _, chosen, forest = best
    # read for the decision and the calibration, some columns of two small splits; each is read more than once
    held, rows = (quantile_columns(forest, part, protocol.features, levels).persist() for part in (seen.validation, seen.calibration))
    try:
        decision = _decide(protocol, held)
        low, mid, high = (level_name(x) for x in quantiles)
        coverage = quantiles[2] - quantiles[0]
        found = decisions.conformal_correction(rows, "target", low, high, coverage).first()
        if found is None:
            raise ValueError("the calibration split is empty")
        lower, upper = S.calibrated(F.col(low), F.col(mid), F.col(high), found["correction"])
        width = rows.agg(F.avg(upper - lower)).first()[0]
    finally:
        for part in (held, rows):
            part.unpersist()
    settings = {
        "quantiles": quantiles, "levels": levels, "correction": found["correction"], "coverage": coverage, "calibration_rows": found["n"],
        "mean_width": width, "decision": decision, "selected": chosen, "trials": trials,
    }
    return Quantile(forest, tuple(protocol.features), settings)


@register("predictor", QUANTILE)
def _load_quantile(spark: SparkSession, record: dict, directory: str) -> Quantile:
    from pyspark.ml.regression import RandomForestRegressionModel

    m = record["model"]
    forest = fits.QuantileForest(RandomForestRegressionModel.load(f"{directory}/forest"), spark.read.parquet(f"{directory}/leaves"), "_x", m["trees"])
    return Quantile(forest, tuple(m["columns"]), {k: v for k, v in m.items() if k not in ("trainer", "columns", "trees")})


@dataclass(frozen=True)
class Screen:
    """A forest whose classes weigh alike; `apply` adds the score of the positive class.

    `settings` tells how it was grown and how well its ranking finds positives on validation."""

    model: object
    columns: tuple[str, ...]
    positive: str
    settings: dict

    def apply(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        scored = self.model.transform(_arrayed(rows, self.columns).withColumn("features", array_to_vector("_x")))
        return scored.withColumn("score", F.get(vector_to_array("probability"), 1)).select(*rows.columns, "score")

    def describe(self) -> dict:
        return {"trainer": "dense_mesh_screen", "columns": list(self.columns), "positive": self.positive, **self.settings}

    def save(self, spark: SparkSession, directory: str) -> dict:
        self.model.write().overwrite().save(f"{directory}/forest")
        return {"forest": tree_digest(spark, f"{directory}/forest")}


#: The shares of the highest scores that a ranking is told for.
REPORTED_FRACTIONS = (0.01, 0.02, 0.05, 0.1, 0.15, 0.25)


@register("trainer", "dense_mesh_screen")
def _screen(protocol, seen):
    """Grown on train; how precise its ranking is at the top is measured on validation and kept in the record."""
    d, q = protocol.dataset.derive, protocol.parameters
    rows = _arrayed(seen.train, protocol.features).filter("target is not null")
    classes = {r["target"] for r in rows.select("target").distinct().limit(3).collect()}
    if classes != {d.positive, d.negative}:
        raise ValueError(f"train has the classes {sorted(classes)}, not {sorted((d.positive, d.negative))}")
    grown = {"trees": q.get("trees", 500), "min_samples_leaf": q.get("min_samples_leaf", 1), "depth": q.get("depth"), "seed": q.get("seed", 0)}
    rows = rows.select("_x", (F.col("target") == d.positive).cast("int").alias("is_positive"))
    forest = fits.balanced_forest(rows, "_x", "is_positive", grown["trees"], grown["seed"], grown["min_samples_leaf"], grown["depth"])
    screen = Screen(forest, tuple(protocol.features), d.positive, {})
    found = screen.apply(seen.validation).select("sample_id", "score", (F.col("target") == d.positive).alias("is_positive")).persist()
    try:
        rate = ranking.scored(found, "score", F.col("is_positive")).agg(F.avg(F.col("is_positive").cast("int"))).first()[0]
        if rate is None:
            raise ValueError("the validation split is empty")
        fractions = [r.asDict() for r in ranking.top_fractions(found, "score", "sample_id", F.col("is_positive"), REPORTED_FRACTIONS).orderBy("fraction").collect()]
    finally:
        found.unpersist()
    decision = {"rule": "ranking", "selected_on": "validation", "positive_rate": rate, "fractions": fractions}
    classes = {"positive": d.positive, "negative": d.negative, "threshold": d.threshold}
    return Screen(forest, tuple(protocol.features), d.positive, {"grown": grown | {"depth": forest.getMaxDepth()}, "classes": classes, "decision": decision})


@register("predictor", "dense_mesh_screen")
def _load_screen(spark: SparkSession, record: dict, directory: str) -> Screen:
    from pyspark.ml.classification import RandomForestClassificationModel

    m = record["model"]
    settings = {k: v for k, v in m.items() if k not in ("trainer", "columns", "positive")}
    return Screen(RandomForestClassificationModel.load(f"{directory}/forest"), tuple(m["columns"]), m["positive"], settings)


@dataclass(frozen=True)
class Head:
    """A network on features that come from elsewhere; `apply` adds the score of the positive class."""

    network: networks.Network
    columns: tuple[str, ...]
    positive: str
    settings: dict
    training: dict

    def apply(self, rows: DataFrame) -> DataFrame:
        return self.network.scored(_arrayed(rows, self.columns), "_x").drop("_x")

    def describe(self) -> dict:
        return {"trainer": "mlp_head", "columns": list(self.columns), "positive": self.positive, "settings": self.settings, "training": self.training}

    def save(self, spark: SparkSession, directory: str) -> dict:
        n = self.network
        arrays = {"mean": n.mean, "scale": n.scale} | n.params | {f"running_{what}{l}": a for l, pair in enumerate(n.stats) for what, a in zip(("mean", "variance"), pair)}
        rows = [(k, list(a.shape), a.ravel().tolist()) for k, a in sorted(arrays.items())]
        spark.createDataFrame(rows, WEIGHTS).coalesce(1).write.mode("overwrite").parquet(f"{directory}/weights")
        return {"weights": tree_digest(spark, f"{directory}/weights")}


WEIGHTS = "name string, shape array<int>, value array<double>"


@register("trainer", "mlp_head")
def _head(protocol, seen):
    positive, s = protocol.evaluation.positive or evaluate.default_positive(seen.train, "target"), networks.settings_of(protocol.parameters)
    y = F.when(F.col("target").isNotNull(), (F.col("target") == positive).cast("int"))
    rows = [_arrayed(r, protocol.features).select(F.col("sample_id").alias("id"), F.col("_x").alias("x"), y.alias("y")) for r in (seen.train, seen.validation)]
    network, training = networks.fit_network(*rows, s)
    return Head(network, tuple(protocol.features), positive, {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(s).items()}, training)


@register("predictor", "mlp_head")
def _load_head(spark: SparkSession, record: dict, directory: str) -> Head:
    m = record["model"]
    # a bounded model: the arrays of its layers
    found = {r["name"]: np.array(r["value"]).reshape(r["shape"]) for r in spark.read.schema(WEIGHTS).parquet(f"{directory}/weights").collect()}
    stats = [(found.pop(f"running_mean{l}"), found.pop(f"running_variance{l}")) for l in range(len(m["settings"]["hidden"]))]
    network = networks.Network({k: v for k, v in found.items() if k not in ("mean", "scale")}, stats, found["mean"], found["scale"])
    return Head(network, tuple(m["columns"]), m["positive"], m["settings"], m["training"])


@register("features", "tabular")
def _tabular(samples: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    return lookups.lookup(samples, table, "sample_id", columns)


def tree_digest(spark: SparkSession, directory: str) -> str:
    """A digest of a folder's files at any depth, by their folders, what they are and their bytes.

    Spark names parts anew in each write, so of a part's name only its number and its ending count."""
    files = file_listing(spark, directory, deep=True).filter(~F.element_at(F.split("name", "/"), -1).rlike("^[_.]"))
    plain = F.regexp_replace("name", r"(part-\d+)[^/.]*", "$1")
    lines = F.array_sort(F.collect_list(F.concat_ws(":", plain, "sha256")))
    return files.agg(F.sha2(F.concat_ws("\n", lines).cast("binary"), 256)).first()[0]


def save_model(spark: SparkSession, fitted, protocol, directory: str) -> dict:
    """Writes the model and its record: what it is for, in which columns, and the digests of its files."""
    d, released = protocol.dataset, TRAINERS[protocol.model][2]
    record = {
        "record_version": RECORD_VERSION, "role": "model", "name": protocol.name, "runtime": S.runtime_of(protocol.name) if released else None,
        "target": {"name": d.target, "contract": d.contract, "units": d.units}, "features": list(protocol.features),
        "artifacts": fitted.save(spark, directory), "model": fitted.describe(),
    }
    writers.write_json(f"{directory}/{RECORD}", record, spark)
    return record


def read_record(spark: SparkSession, directory: str) -> dict:
    return json.loads(bytes(spark.read.format("binaryFile").load(f"{directory}/{RECORD}").first()["content"]))


def check_record(record: dict, target: tuple[str, str, str] | None = None) -> dict:
    """Rules of a record; the first that is broken is told. `target` is the (name, contract, units) that is wanted."""
    if record.get("record_version") != RECORD_VERSION:
        raise ValueError(f"records of version {record.get('record_version')} can't be read")
    role = record.get("role", "model")
    if role not in ROLES:
        raise ValueError(f"unknown role {role}")
    if role != "model":
        raise ValueError("this record extracts features and answers no question")
    missing = {"target", "features", "artifacts", "model"} - set(record)
    if missing:
        raise ValueError(f"the record lacks {sorted(missing)}")
    known = TRAINERS.get(record["model"].get("trainer"))
    if known is None:
        raise ValueError(f"nothing serves {record['model'].get('trainer')}")
    if record["model"].get("columns") != record["features"]:
        raise ValueError("the model's columns aren't the record's features in their order")
    if known[2] and record.get("runtime") != S.runtime_of(record.get("name", "")):
        raise ValueError(f"the name {record.get('name')} doesn't claim the runtime {record.get('runtime')}")
    if record["model"]["trainer"] == QUANTILE and not record["model"].get("mean_width", -1) >= 0:
        raise ValueError("an interval needs a width of at least 0")
    if target:
        found = record["target"]
        if (found.get("name"), found.get("contract")) != tuple(target[:2]):
            raise ValueError(f"the record predicts {found.get('name')} by {found.get('contract')}")
        if found.get("units") != target[2]:
            raise ValueError(f"the contract is in {target[2]}, the record in {found.get('units')}")
    return record


def load_model(spark: SparkSession, directory: str, target: tuple[str, str, str] | None = None, artifacts: dict[str, str] | None = None):
    """A model as it was saved: record checked, digests of its files before anything of them is read.

    `artifacts` names other digests to hold the files against, which pins what may be loaded."""
    record = check_record(read_record(spark, directory), target)
    for name, digest in {**record["artifacts"], **(artifacts or {})}.items():
        if tree_digest(spark, f"{directory}/{name}") != digest:
            raise ValueError(f"{name} isn't what the record says")
    return predictor(record["model"]["trainer"])(spark, record, directory)


def served(rows: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Scores rows batch by batch with a model that each task makes once, from what `make` carries.

    This is the seam for structure featurizers and neural models: they come as Arrow batches, with one
    model for each Python worker and no state between batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(run, schema)
