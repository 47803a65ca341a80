"""A training run: split, fit on train, choose on validation, calibrate, score a baseline and the model on every split."""

from __future__ import annotations

import os
import platform
import sys
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from importlib import metadata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import checks, decisions, evaluate, fits, ranking, splits
from ..sources import writers
from .models import save_model, trainer
from .protocol import RANKED, Protocol, to_toml


@dataclass(frozen=True)
class TrainingContext:
    """What a trainer may see. There is no test split in it."""

    train: DataFrame
    validation: DataFrame
    calibration: DataFrame


def context(rows: DataFrame) -> TrainingContext:
    return TrainingContext(*(rows.filter(F.col("split") == s) for s in splits.SPLITS[:3]))


def train_median(train: DataFrame, target: str) -> float:
    """The exact median, the mean of the middle two."""
    return train.agg(F.median(target)).first()[0]


def train_majority(train: DataFrame, target: str) -> str:
    return splits.majority(train, [], target).first()["majority"]


#: What a source says of a row; what it doesn't say is null.
SAID = {"prediction": None, "score": "double", "lower": "double", "upper": "double", "median": "double"}


def predictions(rows: DataFrame, key: str, target: str, sources: Mapping[str, Column | Mapping[str, Column]]) -> DataFrame:
    """(sample_id, split, source, truth, prediction, ...): each row once for each source, from one scan.

    A source is its prediction, or columns out of `SAID`; those that no source has are left out."""
    said = {name: c if isinstance(c, Mapping) else {"prediction": c} for name, c in sources.items()}
    names = [n for n in SAID if any(n in c for c in said.values())]
    each = [F.struct(F.lit(s).alias("source"), *((c[n] if n in c else F.lit(None).cast(SAID[n])).alias(n) for n in names)) for s, c in said.items()]
    out = rows.select(F.col(key).cast("string").alias("sample_id"), "split", F.col(target).alias("truth"), F.explode(F.array(*each)).alias("s"))
    return out.select("sample_id", "split", "s.source", "truth", *(f"s.{n}" for n in names))


def ridge_against_median(rows: DataFrame, key: str, features: list[str], target: str, seed: int = 42, l2: float = 1.0) -> DataFrame:
    """(source, split, n, mae, rmse, r2): does a ridge beat the train median, split by split?"""
    assignment = splits.split_rows(rows, key, (0.7, 0.1, 0.1, 0.1), seed)
    # read by each fit and by the scores: kept until the session clears its cache, made anew where lost
    parted = splits.partition(rows, key, assignment).persist()
    seen = context(parted)
    median, model = train_median(seen.train, target), fits.ridge(seen.train, features, target, l2)
    preds = predictions(parted, "sample_id", target, {"baseline": F.lit(float(median)), "model": model.score()})
    return evaluate.regression(preds, ["mae", "rmse", "r2"], ["source", "split"])


@dataclass(frozen=True)
class Run:
    """What a run gives: predictions by source, metrics by source and split, by band if there are bands, the model."""

    protocol: Protocol
    assignment: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    bands: DataFrame | None
    threshold: float | None
    model: object
    summary: dict
    started_at: datetime

    def close(self) -> None:
        """Lets go of what the run has kept in memory; its frames can still be read, they are made anew then."""
        self.assignment.unpersist()


def _assigned(p: Protocol, samples: DataFrame) -> DataFrame:
    label = "target" if p.split.stratify else None
    if p.split.method == "group":
        return splits.split_groups(samples, "sample_id", "group", p.split.ratios, p.split.seed, label)
    return splits.split_rows(samples, "sample_id", p.split.ratios, p.split.seed, label)


def execute(protocol: Protocol, samples: DataFrame, assignment: DataFrame | None = None) -> Run:
    """Runs a configuration over samples (sample_id, target, group?, features...), by given splits if there are some.

    Whatever is fitted sees train, whatever is chosen sees validation, intervals are calibrated on
    calibration; test is scored once, at the end. `close` the run once its frames are written."""
    p, e, started = protocol, protocol.evaluation, datetime.now(timezone.utc)
    d = p.dataset.derive
    if d:
        samples = samples.withColumn("target", S.derived_class(F.col("target").cast("double"), d.threshold, d.positive, d.negative))
    assignment = (assignment if assignment is not None else _assigned(p, samples)).select("sample_id", "split").persist()
    required = [s for s, r in zip(splits.SPLITS, p.split.ratios) if r > 0]
    checks.require(splits.check_assignment(assignment, samples, "sample_id", "group" if p.split.method == "group" else None, required))
    rows = splits.partition(samples, "sample_id", assignment)
    seen = context(rows)
    if p.dataset.task == "regression":
        model = trainer(p.model)(p, seen)
        median = train_median(seen.train, "target")
        fitted = model.apply(rows)
        # what the model's rule publishes is what is predicted and scored; the median only tells the loss of the middle level
        if "published" in fitted.columns:
            own = {"prediction": F.col("published"), "lower": F.col("lower"), "upper": F.col("upper"), "median": F.col("value")}
        else:
            own = {"prediction": F.col("value")}
        preds = predictions(fitted, "sample_id", "target", {"baseline": F.lit(float(median)), "model": own})
        found, banded = evaluate.everything(preds, e.metrics, p.parameters.get("quantiles", (0.05, 0.5, 0.95)), e.bands)
        told = {"baseline_constant": median, "decision": model.describe().get("decision")}
        return Run(p, assignment, preds, found, banded, None, model, told, started)
    positive = e.positive or evaluate.default_positive(seen.train, "target")
    classes = checks.two_classes(seen.train, "target", positive).first()
    if classes["classes"] != 2 or not classes["has_positive"]:
        raise checks.DataError(f"train needs two classes, {positive} one of them")
    negative = seen.train.filter(F.col("target") != positive).agg(F.min("target")).first()[0]
    model = trainer(p.model)(p, seen)
    scored, chosen = model.apply(rows), None
    if e.threshold_metric:
        on = scored.filter("split = 'validation'")
        best = decisions.select_threshold(on, "score", F.col("target") == positive, e.threshold_metric, e.min_recall).first()
        if best is None:
            raise checks.DataError("no threshold keeps the recall on validation")
        chosen = best["threshold"]
    most = splits.majority(seen.train, [], "target").first()
    frequency = most["n"] / seen.train.filter("target is not null").count()
    sure = frequency if most["majority"] == positive else 1 - frequency
    label = S.derived_class(F.col("score"), 0.5 if chosen is None else chosen, positive, negative)
    sources = {"baseline": {"prediction": F.lit(most["majority"]), "score": F.lit(float(sure))}, "model": {"prediction": label, "score": F.col("score")}}
    preds = predictions(scored, "sample_id", "target", sources)
    by = ["source", "split"]
    found = evaluate.classification(preds, [m for m in e.metrics if m not in RANKED], positive, by)
    for name, area in (("roc_auc", ranking.roc_auc), ("pr_auc", ranking.pr_auc)):
        if name in e.metrics:
            found = found.join(area(preds, by, "score", F.col("truth") == positive).select(*by, name), by, "left")
    summary = {
        "positive": positive, "negative": negative, "baseline_label": most["majority"],
        "threshold": {"value": 0.5 if chosen is None else chosen, "metric": e.threshold_metric, "min_recall": e.min_recall, "selected_on": "validation" if e.threshold_metric else None},
    }
    return Run(p, assignment, preds, found.select(*by, "n", *e.metrics), None, chosen, model, summary, started)


def environment_record() -> dict:
    """Interpreter, packages and machine of the driver."""
    packages = {d.metadata["Name"]: d.version for d in metadata.distributions() if d.metadata["Name"]}
    return {
        "python": sys.version.split()[0], "implementation": platform.python_implementation(), "platform": platform.platform(),
        "machine": platform.machine(), "cpus": os.cpu_count(), "packages": dict(sorted(packages.items())),
    }


def run_record(run: Run, run_id: str, reused_splits: bool) -> dict:
    """What ran and when, in UTC."""
    return {
        "run_id": run_id, "protocol": run.protocol.name, "status": "completed", "started_at": run.started_at.isoformat(),
        "finished_at": datetime.now(timezone.utc).isoformat(), "splits_reused": reused_splits,
    }


def write_bundle(run: Run, directory: str, run_id: str, dataset: dict | None = None, reused_splits: bool = False) -> dict:
    """Writes a run whole and its manifest: configuration, splits, predictions, metrics, model, data and provenance.

    The manifest's digest is of all that doesn't depend on when or where it ran."""
    spark, p = run.predictions.sparkSession, run.protocol
    writers.write_text(spark, f"{directory}/protocol.toml", to_toml(p.resolved()))
    d = p.dataset
    writers.write_json(f"{directory}/dataset.json", {"target": d.target, "contract": d.contract, "units": d.units, "features": list(p.features), **(dataset or {})}, spark)
    writers.write_file(run.assignment.orderBy("sample_id"), f"{directory}/splits.csv")
    columns = [c for c in writers.PREDICTIONS if c in run.predictions.columns]
    writers.write_file(run.predictions.select(*columns).orderBy("source", "sample_id"), f"{directory}/predictions.csv")
    by = ["source", "split"]
    metrics = {
        "primary": p.evaluation.primary, **run.summary, "metrics": [r.asDict() for r in run.metrics.orderBy(*by).collect()],
        "bands": [r.asDict() for r in run.bands.orderBy(*by, "band").collect()] if run.bands is not None else [],
        "sizes": {r["split"]: r["count"] for r in run.assignment.groupBy("split").count().orderBy("split").collect()},
    }
    writers.write_json(f"{directory}/metrics.json", metrics, spark)
    record = save_model(spark, run.model, p, directory)
    writers.write_json(f"{directory}/environment.json", environment_record(), spark)
    writers.write_json(f"{directory}/run.json", run_record(run, run_id, reused_splits), spark)
    return {"metrics": metrics, "model": record, "manifest": writers.write_manifest(spark, directory)}
