"""A network with batch norms, trained with rows where they are: each task sends sums, never rows.

Layers are linear, batch norm, GELU and dropout; a linear one on top gives a logit. The mean and variance of a batch, and what their
gradients need of the whole batch, are sums over rows, so a step is a few passes: one for each layer's statistics on the way up,
one for each on the way down. A step therefore gives the same however rows are dealt to tasks. The weights are a bounded model that
the driver holds and sends along."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking

EPS, MOMENTUM = 1e-5, 0.1
# Decays of AdamW's means, and the relative gain that a plateau's end needs.
BETAS, TINY, GAIN = (0.9, 0.999), 1e-8, 1e-4

Params = dict[str, np.ndarray]

_erf = np.frompyfunc(math.erf, 1, 1)


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x times the normal distribution function of x, and its derivative."""
    below = 0.5 * (1 + _erf(x / math.sqrt(2)).astype(np.float64))
    return x * below, below + x * np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def kept(keys: np.ndarray, units: int, layer: int, step: int, seed: int, dropout: float) -> np.ndarray:
    """Which units of a layer stay in a step, as factors: drawn from a hash of the row's key, so from nothing else."""
    if not dropout:
        return np.ones((len(keys), units))
    with np.errstate(over="ignore"):
        where = np.uint64((seed * 1_000_003 + step) * 64 + layer) * np.uint64(0x9E3779B97F4A7C15)
        x = (keys.astype(np.int64).view(np.uint64) ^ where)[:, None] + np.arange(1, units + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)) / float(1 << 53) >= dropout) / (1 - dropout)


def first_params(width: int, hidden: Sequence[int], seed: int) -> Params:
    """Weights drawn evenly within one over the root of a layer's inputs; norms that change nothing."""
    draw, out, sizes = np.random.default_rng(seed), {}, [width, *hidden]
    for l, (a, b) in enumerate(zip(sizes, sizes[1:])):
        out |= {f"w{l}": draw.uniform(-1, 1, (b, a)) / math.sqrt(a), f"b{l}": draw.uniform(-1, 1, b) / math.sqrt(a), f"g{l}": np.ones(b), f"o{l}": np.zeros(b)}
    return out | {"w": draw.uniform(-1, 1, sizes[-1]) / math.sqrt(sizes[-1]), "b": draw.uniform(-1, 1, 1) / math.sqrt(sizes[-1])}


@dataclass(frozen=True)
class Settings:
    """What the trainer does unless it is told otherwise."""

    epochs: int = 100
    batch_size: int = 128
    learning_rate: float = 0.001
    weight_decay: float = 0.0001
    patience: int = 20
    scheduler_factor: float = 0.5
    scheduler_patience: int = 5
    selection_metric: str = "validation_roc_auc"
    hidden: tuple[int, ...] = (256, 64)
    dropout: float = 0.25
    seed: int = 0


SELECTION = ("validation_loss", "validation_roc_auc")


def settings_of(given: dict) -> Settings:
    """Settings with defaults; the first value that can't be is told."""
    s = replace(Settings(), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    for name in ("epochs", "batch_size", "patience", "scheduler_patience"):
        if not whole(getattr(s, name)) or getattr(s, name) < 1:
            raise ValueError(f"{name} must be a whole number from 1")
    if not (isinstance(s.hidden, tuple) and s.hidden and all(whole(h) and h > 0 for h in s.hidden)):
        raise ValueError("hidden must be a list of whole numbers from 1")
    if not (number(s.learning_rate) and s.learning_rate > 0 and number(s.weight_decay) and s.weight_decay >= 0):
        raise ValueError("the learning rate must be above 0 and the decay not below")
    if not (number(s.scheduler_factor) and 0 < s.scheduler_factor < 1 and number(s.dropout) and 0 <= s.dropout < 1):
        raise ValueError("the scheduler's factor and the dropout must be shares")
    if s.selection_metric not in SELECTION:
        raise ValueError(f"epochs are selected by {' or '.join(SELECTION)}")
    return s


def logits(p: Params, stats: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Of rows of features, with given means and variances and no dropout."""
    for l, (mean, variance) in enumerate(stats):
        x = gelu((x @ p[f"w{l}"].T + p[f"b{l}"] - mean) / np.sqrt(variance + EPS) * p[f"g{l}"] + p[f"o{l}"])[0]
    return x @ p["w"] + p["b"][0]


def loss_of(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cross entropy of each row, which no large logit overflows."""
    return np.maximum(logit, 0) - logit * y + np.log1p(np.exp(-np.abs(logit)))


def statistics_sums(p: Params, stats: list, x: np.ndarray, keys: np.ndarray, draw: tuple) -> Params:
    """What the next layer's statistics need of some rows: their number, and sums of its values and of their squares."""
    for l, _ in enumerate(stats):
        x = _layer(p, stats, l, x, keys, draw)[-1]
    z = x @ p[f"w{len(stats)}"].T + p[f"b{len(stats)}"]
    return {"n": np.array([float(len(z))]), "sum": z.sum(axis=0), "squares": (z * z).sum(axis=0)}


def _layer(p: Params, stats: list, l: int, x: np.ndarray, keys: np.ndarray, draw: tuple) -> tuple:
    mean, variance = stats[l]
    even = (x @ p[f"w{l}"].T + p[f"b{l}"] - mean) / np.sqrt(variance + EPS)
    value, slope = gelu(even * p[f"g{l}"] + p[f"o{l}"])
    stay = kept(keys, value.shape[1], l, *draw)
    return even, slope * stay, value * stay


def gradient_sums(p: Params, stats: list, back: dict[int, tuple], n: float, x: np.ndarray, y: np.ndarray, keys: np.ndarray, draw: tuple) -> Params:
    """What some rows add to the gradient of the batch's mean loss, as far down as is known.

    `back` has, for the layers above, the sums of their norms' gradients over the whole batch; the result has those of the next
    layer below and the weights in between. With all layers known it has the lowest weights."""
    layers, inputs = len(stats), [x]
    seen = []
    for l in range(layers):
        even, slope, x = _layer(p, stats, l, x, keys, draw)
        seen.append((even, slope))
        inputs.append(x)
    logit = x @ p["w"] + p["b"][0]
    d = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y) / n
    out: Params = {}
    if not back:
        out |= {"w": x.T @ d, "b": np.array([d.sum()]), "loss": np.array([loss_of(logit, y).sum()])}
    down = np.outer(d, p["w"])
    for l in range(layers - 1, -1, -1):
        even, slope = seen[l]
        down = down * slope
        if l not in back:
            return out | {f"g{l}": (down * even).sum(axis=0), f"o{l}": down.sum(axis=0)}
        gain, offset = back[l]
        # the batch's mean and variance move with each row, which takes the batch's own shares out
        z = p[f"g{l}"] / np.sqrt(stats[l][1] + EPS) * (down - offset / n - even * gain / n)
        if l == layers - len(back):  # the lowest layer of which enough is known; those above were told before
            out |= {f"w{l}": z.T @ inputs[l], f"b{l}": z.sum(axis=0)}
        down = z @ p[f"w{l}"]
    return out


def added(parts: Iterator[Params]) -> Params:
    total: Params = {}
    for part in parts:
        for k, v in part.items():
            total[k] = total[k] + v if k in total else v
    return total


def summed(rows: DataFrame, of, shapes: dict[str, tuple]) -> Params:
    """The sums over all rows (x, y, key) of arrays that `of` makes of a batch: added in tasks, then by place, so the driver reads them once."""
    names, sizes = list(shapes), [math.prod(s) for s in shapes.values()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = added(of(np.stack(b["x"].to_numpy()).astype(np.float64), b["y"].to_numpy(np.float64), b["key"].to_numpy(np.int64)) for b in batches if len(b))
        if total:
            v = np.concatenate([np.ravel(total[k]) for k in names])
            yield pd.DataFrame({"i": np.arange(len(v)), "v": v})

    found = rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(sum(sizes))
    for r in found:
        flat[r["i"]] = r["v"]
    return {k: a.reshape(shapes[k]) for k, a in zip(names, np.split(flat, np.cumsum(sizes)[:-1]))}


def batch_gradient(rows: DataFrame, p: Params, layers: int, draw: tuple) -> tuple[Params, list, float, float]:
    """(gradient of the mean loss, (mean, sample variance) of each layer, rows, mean loss) of a batch; no gradient of fewer than two rows."""
    stats: list = []
    n = 0.0
    for l in range(layers):
        units = p[f"b{l}"].shape
        s = summed(rows, lambda x, y, key, s=tuple(stats): statistics_sums(p, list(s), x, key, draw), {"n": (1,), "sum": units, "squares": units})
        n = float(s["n"][0])
        if n < 2:
            return {}, [], n, 0.0
        mean = s["sum"] / n
        stats.append((mean, np.maximum(s["squares"] / n - mean * mean, 0.0)))
    gradient: Params = {}
    back: dict[int, tuple] = {}
    for l in range(layers - 1, -2, -1):
        shapes = {} if back else {"w": p["w"].shape, "b": (1,), "loss": (1,)}
        if l < layers - 1:
            shapes |= {f"w{l + 1}": p[f"w{l + 1}"].shape, f"b{l + 1}": p[f"b{l + 1}"].shape}
        if l >= 0:
            shapes |= {f"g{l}": p[f"g{l}"].shape, f"o{l}": p[f"o{l}"].shape}
        part = summed(rows, lambda x, y, key, back=dict(back): gradient_sums(p, stats, back, n, x, y, key, draw), shapes)
        gradient |= part
        if l >= 0:
            back[l] = part[f"g{l}"], part[f"o{l}"]
    loss = float(gradient.pop("loss")[0]) / n
    # what runs along is the variance of samples
    return gradient, [(m, v * n / (n - 1)) for m, v in stats], n, loss


@dataclass(frozen=True)
class Network:
    """A trained network: weights, running means and variances, and what features are divided by."""

    params: Params
    stats: list
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return logits(self.params, self.stats, (x - self.mean) / self.scale)

    def scored(self, rows: DataFrame, features: str, name: str = "score") -> DataFrame:
        """`rows` with the probability of the positive class; a null array has none."""

        def score(x: pd.Series) -> pd.Series:
            some = x.notna().to_numpy()
            out = np.full(len(x), np.nan)
            if some.any():
                out[some] = 1 / (1 + np.exp(-np.clip(self.logits(np.stack(x[some].to_numpy()).astype(np.float64)), -60, 60)))
            return pd.Series(out).astype(object).where(some, None)

        score.__annotations__ = {"x": pd.Series, "return": pd.Series}
        return rows.withColumn(name, F.pandas_udf(score, "double")(F.col(features).cast("array<double>")))


def fit_network(train: DataFrame, validation: DataFrame, s: Settings = Settings()) -> tuple[Network, dict]:
    """(network, record) from rows (id, x, y), y 0 or 1; epochs stop and are chosen on validation, by its loss or minus its ROC area.

    Features are standardized by train. An epoch's batches are drawn by a hash of seed, epoch and id, some `batch_size` rows
    each, so the same rows are a batch however they are dealt. Updates are AdamW's; the rate falls when the objective stays.
    Rows without features or a class don't count; ids that repeat are drawn alike."""
    ready = [r.select("x", F.col("y").cast("double").alias("y"), F.xxhash64("id").alias("key")).filter("x is not null and y is not null") for r in (train, validation)]
    width = ready[0].select(F.size("x")).first()
    if width is None or not ready[1].take(1):
        raise ValueError("train and validation need rows")
    width = width[0]
    at = ready[0].select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    mean, scale = np.zeros(width), np.ones(width)
    for r in at:
        mean[r["at"]], scale[r["at"]] = r["m"], r["s"] if r["s"] > 0 else 1.0
    even = F.transform("x", lambda v, i: (v - F.get(F.lit(mean.tolist()), i)) / F.get(F.lit(scale.tolist()), i))
    held, checked = (r.withColumn("x", even).persist() for r in ready)
    layers, batches = len(s.hidden), max(1, math.ceil(held.count() / s.batch_size))

    def gradients(epoch: int, batch: int, p: Params, step: int):
        some = held.filter(in_batch(s.seed, epoch, batch, batches)) if batches > 1 else held
        return batch_gradient(some, p, layers, (step, s.seed, s.dropout))

    def judged(p: Params, running: list) -> tuple[float, float]:
        network = Network(p, running, np.zeros(width), np.ones(width))
        found = summed(checked, lambda x, y, key: {"n": np.array([float(len(y))]), "loss": np.array([loss_of(network.logits(x), y).sum()])}, {"n": (1,), "loss": (1,)})
        return float(found["loss"][0] / found["n"][0]), ranking.roc_auc(network.scored(checked, "x"), [], "score", F.col("y") > 0).first()["roc_auc"]

    try:
        p, running, record = train_epochs(first_params(width, s.hidden, s.seed), [(np.zeros(h), np.ones(h)) for h in s.hidden], batches, gradients, judged, s)
    finally:
        held.unpersist()
        checked.unpersist()
    return Network(p, running, mean, scale), record


def in_batch(seed: int, epoch: int, batch: int, batches: int):
    """Whether a row with a `key` is in a batch of an epoch: drawn from a hash, so from nothing else."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "key"), F.lit(batches)) == batch


def train_epochs(p: Params, running: list, batches: int, gradients, judged, s: Settings) -> tuple[Params, list, dict]:
    """(weights, running statistics, record) of the best epoch.

    `gradients` gives (gradient, statistics, rows, mean loss) of a batch and `judged` (loss, ROC area) on validation. Updates are
    AdamW's."""
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    rate, step, history, objectives, best = s.learning_rate, 0, [], [], None
    plateau, bad = math.inf, 0
    for epoch in range(1, s.epochs + 1):
        total = rows = 0.0
        for batch in range(batches):
            gradient, stats, n, loss = gradients(epoch, batch, p, step)
            if n < 2:
                continue  # the variance of one row tells nothing
            step += 1
            total, rows = total + loss * n, rows + n
            for k, g in gradient.items():
                first[k] = BETAS[0] * first[k] + (1 - BETAS[0]) * g
                second[k] = BETAS[1] * second[k] + (1 - BETAS[1]) * g * g
                move = (first[k] / (1 - BETAS[0] ** step)) / (np.sqrt(second[k] / (1 - BETAS[1] ** step)) + TINY)
                p = p | {k: p[k] * (1 - rate * s.weight_decay) - rate * move}
            running = [(a + MOMENTUM * (m - a), b + MOMENTUM * (v - b)) for (a, b), (m, v) in zip(running, stats)]
        loss, area = judged(p, running)
        objectives.append(loss if s.selection_metric == "validation_loss" else -area)
        # the rate falls once the objective hasn't gained for longer than the scheduler's patience
        if not math.isfinite(plateau) or objectives[-1] < plateau - GAIN * plateau:
            plateau, bad = objectives[-1], 0
        else:
            bad += 1
        if bad > s.scheduler_patience:
            rate, bad = rate * s.scheduler_factor, 0
        history.append({"epoch": epoch, "train_loss": total / max(rows, 1), "validation_loss": loss, "validation_roc_auc": area, "learning_rate": rate})
        since = len(objectives) - 1 - int(np.argmin(objectives))
        if since == 0:
            best = p, running
        elif since >= s.patience:
            break
    chosen = int(np.argmin(objectives)) + 1
    record = {
        "selected_epoch": chosen, "selection_metric": s.selection_metric, "validation_loss": history[chosen - 1]["validation_loss"],
        "validation_roc_auc": history[chosen - 1]["validation_roc_auc"], "epochs_run": len(history), "stopped_early": len(history) < s.epochs,
        "criterion": "bce_with_logits", "optimiser": "adamw", "scheduler": "reduce_on_plateau", "history": history,
    }
    return *best, record
