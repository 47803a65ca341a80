"""Training configurations: frozen dataclasses, read from TOML on the driver and checked before any data are."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields

from ..functions.metrics import CLASSIFICATION, INTEGER, REGRESSION
from ..functions.scalars import RELEASE
from ..operators.networks import Settings, settings_of
from ..operators.splits import check_ratios

RANKED = ("roc_auc", "pr_auc")
INTERVALS = ("interval_coverage", "mean_interval_width", "pinball")
#: The trainer that predicts intervals.
QUANTILE = "quantile_random_forest"
#: trainer -> the task that it is for, the parameters that it knows, and the third part of names of what it releases.
TRAINERS: dict[str, tuple[str, set[str], str | None]] = {
    "linear_regression": ("regression", {"l2"}, None),
    "logistic_regression": ("classification", {"steps", "rate", "l2"}, None),
    QUANTILE: ("regression", {"trees", "quantiles", "decision_levels", "search", "seed"}, "qrf"),
    "mlp_head": ("classification", {f.name for f in fields(Settings)}, None),
    "dense_mesh_screen": ("classification", {"trees", "min_samples_leaf", "depth", "seed"}, "screen"),
}


class ConfigError(ValueError):
    """A configuration that can't be run."""


@dataclass(frozen=True)
class Derived:
    threshold: float
    positive: str
    negative: str


@dataclass(frozen=True)
class Dataset:
    task: str
    target: str
    contract: str
    units: str
    record_id: str | None = None
    derive: Derived | None = None


@dataclass(frozen=True)
class Split:
    method: str = "random"
    ratios: tuple[float, ...] = (0.7, 0.1, 0.1, 0.1)
    seed: int = 0
    stratify: bool = False


@dataclass(frozen=True)
class Evaluation:
    metrics: tuple[str, ...]
    primary: str
    positive: str | None = None
    threshold_metric: str | None = None
    min_recall: float | None = None
    bands: tuple[float, ...] = ()
    decision_bands: tuple[float, ...] = ()
    decision_metric: str | None = None
    max_underprediction: float | None = None
    decision_rule: str | None = None


@dataclass(frozen=True)
class Protocol:
    name: str
    dataset: Dataset
    split: Split
    features: tuple[str, ...]
    model: str
    evaluation: Evaluation
    parameters: dict = field(default_factory=dict)

    def resolved(self) -> dict:
        """All settings with their defaults made explicit; `parse` of it as TOML gives this configuration again."""
        return asdict(self)


def _made(kind, found: dict, where: str, **more):
    known = {f.name for f in fields(kind)}
    if unknown := set(found) - known:
        raise ConfigError(f"{where}: unknown keys {sorted(unknown)}")
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items()} | more
    try:
        return kind(**values)
    except TypeError as missing:
        raise ConfigError(f"{where}: {missing}") from None


def check(p: Protocol) -> Protocol:
    """Rules between settings; the first that is broken is told."""

    def rule(holds: bool, said: str) -> None:
        if not holds:
            raise ConfigError(said)

    e, task = p.evaluation, p.dataset.task
    rule(re.match(RELEASE, p.name) is not None, "the name must have five dotted parts, the last a version")
    rule(task in ("regression", "classification"), "the task must be regression or classification")
    rule(p.split.method in ("random", "group"), "the split method must be random or group")
    try:
        check_ratios(p.split.ratios)
    except ValueError as wrong:
        raise ConfigError(str(wrong)) from None
    rule(isinstance(p.split.seed, int) and not isinstance(p.split.seed, bool) and p.split.seed >= 0, "the seed must be a whole number from 0")
    rule(not p.split.stratify or task == "classification", "only classes can be stratified")
    rule(p.dataset.derive is None or task == "classification", "derived targets are classes")
    rule(bool(p.features) and len(set(p.features)) == len(p.features), "features must be named, once each")
    known: Sequence[str] = [*REGRESSION, *INTERVALS] if task == "regression" else [*CLASSIFICATION, *RANKED]
    rule(bool(e.metrics) and len(set(e.metrics)) == len(e.metrics), "metrics must be named, once each")
    rule(all(m in known for m in e.metrics), f"metrics of this task are {sorted(known)}")
    rule(e.primary in e.metrics, "the primary metric must be one of the metrics")
    rule(e.min_recall is None or (e.threshold_metric is not None and 0 <= e.min_recall <= 1), "a recall floor needs a threshold metric and a share")
    rule(e.threshold_metric is None or e.threshold_metric in CLASSIFICATION, "thresholds are chosen by a classification metric")
    rule(list(e.bands) == sorted(set(e.bands)), "bands must increase")
    rule(not e.bands or task == "regression", "bands are of numbers")
    rule(all(x is None for x in (e.threshold_metric, e.positive, e.min_recall)) or task == "classification", "thresholds and positive classes are for classes")
    rule(e.decision_metric is None or e.decision_metric in REGRESSION, "a decision needs a regression metric")
    rule(e.decision_rule in (None, "quantile", "offset", "quantile_by_band"), "the decision rule isn't known")
    rule((e.decision_rule is None) == (e.decision_metric is None), "a decision has a rule and a metric")
    rule(e.max_underprediction is None or (e.decision_metric is not None and 0 <= e.max_underprediction < 1), "a ceiling of underpredictions needs a decision metric")
    rule(list(e.decision_bands) == sorted(set(e.decision_bands)), "decision bands must increase")
    rule((e.decision_rule in ("offset", "quantile_by_band")) == bool(e.decision_bands), "offsets and levels by band need decision bands, and nothing else has them")
    rule(e.decision_rule != "offset" or (e.decision_metric in INTEGER and e.max_underprediction is not None), "offsets are for whole numbers and need a ceiling")
    rule(p.model in TRAINERS, f"trainers are {sorted(TRAINERS)}")
    kind, parameters, released = TRAINERS[p.model]
    rule(kind == task, f"{p.model} is for {kind}")
    rule(not set(p.parameters) - parameters, f"{p.model} knows {sorted(parameters)}")
    rule(released is None or p.name.split(".")[2] == released, f"{p.model} releases names whose third part is {released}")
    intervals = p.model == QUANTILE
    rule(intervals or not any(m in INTERVALS for m in e.metrics), "this trainer predicts no intervals")
    rule(intervals or e.decision_metric is None, "this trainer has no levels to decide between")
    rule(p.model != "dense_mesh_screen" or p.dataset.derive is not None, "a screen's classes are derived from a number: it needs dataset.derive")
    shares = dict(zip(("train", "validation", "calibration", "test"), p.split.ratios))
    rule(shares["validation"] > 0 or (e.threshold_metric is None and e.decision_metric is None), "what is chosen needs a validation split")
    rule(shares["validation"] > 0 or p.model != "dense_mesh_screen", "a ranking is measured on a validation split")
    if p.model == "mlp_head":
        rule(shares["validation"] > 0, "epochs are chosen on a validation split")
        try:
            settings_of(p.parameters)
        except ValueError as wrong:
            raise ConfigError(str(wrong)) from None
    if intervals:
        quantiles, levels = p.parameters.get("quantiles", [0.05, 0.5, 0.95]), p.parameters.get("decision_levels", [])
        rule(len(quantiles) == 3 and list(quantiles) == sorted(set(quantiles)) and 0 < quantiles[0] and quantiles[2] < 1 and quantiles[1] == 0.5, "quantiles are a lower one, 0.5 and an upper one")
        rule(all(0 < q < 1 for q in levels) and bool(levels) == (e.decision_metric is not None), "decision levels lie between 0 and 1, and a decision needs some")
        rule(shares["calibration"] > 0, "intervals need a calibration split")
        search = p.parameters.get("search", {})
        rule(set(search) <= {"min_samples_leaf", "trees"} and all(isinstance(v, list) and v for v in search.values()), "the search has lists of min_samples_leaf and trees")
        many = any(len(v) > 1 for v in search.values())
        rule(not many or shares["validation"] > 0, "a search needs a validation split")
    return p


def parse(text: str) -> Protocol:
    found = tomllib.loads(text)
    data = dict(found.get("dataset", {}))
    derive = data.pop("derive", None)
    dataset = _made(Dataset, data, "dataset", **({"derive": _made(Derived, derive, "dataset.derive")} if derive else {}))
    split, evaluation = _made(Split, found.get("split", {}), "split"), _made(Evaluation, found.get("evaluation", {}), "evaluation")
    rest = {k: v for k, v in found.items() if k not in ("dataset", "split", "evaluation")}
    return check(_made(Protocol, rest, "protocol", dataset=dataset, split=split, evaluation=evaluation))


def to_toml(document: dict) -> str:
    """A document of tables, lists and scalars as TOML; values that are None are left out."""

    def said(value) -> str:
        if isinstance(value, (list, tuple)):
            return f"[{', '.join(map(said, value))}]"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, (str, int, float)):
            return json.dumps(value)
        raise TypeError(f"TOML has no {type(value).__name__}")

    def table(name: str, content: dict) -> str:
        own = [f"{json.dumps(k) if not re.fullmatch('[A-Za-z0-9_-]+', k) else k} = {said(v)}" for k, v in content.items() if v is not None and not isinstance(v, dict)]
        below = [table(f"{name}.{k}" if name else k, v) for k, v in content.items() if isinstance(v, dict)]
        return "\n".join([*([f"\n[{name}]"] if name else []), *own, *below])

    return table("", document) + "\n"


def load(path: str) -> Protocol:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())
