"""Moments that relax on an energy, and oxidation states that balance a composition: small searches, one a row."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import relaxation_reasons
from .features import common_divisor

#: moments along z -> energy and its gradient
Energy = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass(frozen=True)
class Descent:
    """How far a moment moves in a step, when it is done, and how long it may take."""

    farthest: float = 0.05
    flat: float = 1e-2
    first: float = 1e-2
    history: int = 10
    steps: int = 500
    halvings: int = 20


def _direction(gradient: np.ndarray, pairs: deque[tuple[np.ndarray, np.ndarray]], first: float) -> np.ndarray:
    """Downhill by the curvature that past (move, change of gradient) pairs tell: L-BFGS without a matrix."""
    if not pairs:
        return -first * gradient
    out, taken = -gradient, []
    for move, change in reversed(pairs):
        share = (move @ out) / (move @ change)
        taken.append(share)
        out = out - share * change
    move, change = pairs[-1]
    out = out * ((move @ change) / (change @ change))
    for (move, change), share in zip(pairs, reversed(taken)):
        out = out + (share - (change @ out) / (move @ change)) * move
    return out


def descend(energy: Energy, start: np.ndarray, how: Descent = Descent()) -> tuple[np.ndarray, float, np.ndarray, list[float]]:
    """(moments, energy, gradient, energies of all accepted steps, which only fall).

    A step follows L-BFGS over the last moves, or the gradient while there are none or they don't lead
    down; no moment moves farther than `farthest`, and a step is halved until the energy is finite and lower. Ends where the gradient is flat, no
    halving helps, or steps are used up."""
    at = np.array(start, float)
    value, gradient = energy(at)
    pairs: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=how.history)
    path = [value]
    while len(path) <= how.steps and len(at) and not np.max(np.abs(gradient)) < how.flat:
        step = _direction(gradient, pairs, how.first)
        if not step @ gradient < 0:
            pairs.clear()
            step = -how.first * gradient
        step = step * min(1.0, how.farthest / np.max(np.abs(step))) if np.any(step) else step
        for _ in range(how.halvings):
            there, slope = energy(at + step)
            if there < value and np.isfinite(there):
                break
            step = step / 2
        else:
            break
        if step @ (slope - gradient) > 0:
            pairs.append((step, slope - gradient))
        at, value, gradient = at + step, there, slope
        path.append(value)
    return at, value, gradient, path


def site_energy(on_site: np.ndarray, edges: Sequence[tuple[int, int, float]]) -> Energy:
    """Moments that each prefer some size and couple along edges: sum of a m^2 + b m^4 - h m, less J m_i m_j of each edge.

    `on_site` has (a, b, h) of each site; an edge is told once."""
    a, b, h = np.asarray(on_site, float).reshape(-1, 3).T
    i, j, coupling = (np.array([e[k] for e in edges], kind) for k, kind in ((0, int), (1, int), (2, float)))

    def of(m: np.ndarray) -> tuple[float, np.ndarray]:
        value = np.sum(a * m**2 + b * m**4 - h * m) - np.sum(coupling * m[i] * m[j])
        slope = 2 * a * m + 4 * b * m**3 - h
        np.subtract.at(slope, i, coupling * m[j])
        np.subtract.at(slope, j, coupling * m[i])
        return float(value), slope

    return of


def relaxed(structures: DataFrame, make: Callable[[], Callable[[pd.Series], Energy]], how: Descent = Descent()) -> DataFrame:
    """`structures` (structure, moments, symbols, limits, ...) with relaxed moments, energy, zero_energy, gradient, steps, reasons and status.

    `moments` has a vector for each site, of which only z moves. `make` is called once in a task and gives what turns a row
    into its energy: the seam for a model of energies, which must not look from one row at another. Status is
    `invalid` with the reasons of `checks.relaxation_reasons`, `warning_not_converged` where the gradient isn't flat, else `ok`. Null
    moments, and structures without a site, are invalid: there is no energy."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in structures.schema)
    schema += ", z array<double>, energy double, zero_energy double, gradient double, steps int"

    def relax(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        energies = make()
        for batch in batches:
            found = []
            for _, row in batch.iterrows():
                if row["moments"] is None or not len(row["moments"]):
                    found.append((None, math.nan, math.nan, math.nan, 0))
                    continue
                energy = energies(row)
                at, value, gradient, path = descend(energy, np.array([m[2] for m in row["moments"]], float), how)
                found.append((at.tolist(), value, energy(np.zeros(len(at)))[0], float(np.max(np.abs(gradient))), len(path) - 1))
            more = dict(zip(("z", "energy", "zero_energy", "gradient", "steps"), zip(*found) if found else [()] * 5))
            yield batch.assign(**{k: pd.Series(list(v), dtype=object if k == "z" else None, index=batch.index) for k, v in more.items()})

    # a descent is long for how short its row is: rows go to as many tasks as a shuffle has, whatever their bytes
    n = int(structures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = structures.repartition(n, "structure").mapInPandas(relax, schema)
    moved = F.zip_with("moments", "z", lambda m, z: F.array(F.get(m, 0), F.get(m, 1), z))
    out = relaxation_reasons(out.withColumn("moments", F.coalesce(moved, F.array().cast("array<array<double>>"))))
    rough = (F.size("reasons") == 0) & ~(F.col("gradient") < how.flat)
    status = F.when(F.size("reasons") > 0, "invalid").when(rough, "warning_not_converged").otherwise("ok")
    reasons = F.when(rough, F.array(F.lit("the gradient isn't flat"))).otherwise(F.col("reasons"))
    return out.drop("z").withColumns({"status": status, "reasons": reasons})


# Oxidation states

#: Atoms of a reduced composition up to which states are searched for; beyond, they are unknown.
SITES = 1000


def _totals(n: int, states: Sequence[tuple[int, float]]) -> dict[int, float]:
    """The best weight of each charge that n atoms of an element can have together."""
    best = {0: 0.0}
    for _ in range(n):
        more: dict[int, float] = {}
        for charge, weight in best.items():
            for state, w in states:
                if (value := weight + w) > more.get(charge + state, -math.inf):
                    more[charge + state] = value
        best = more
    return best


def balanced_states(counts: Sequence[tuple[str, int]], states: dict[str, list[tuple[int, float]]], sites: int = SITES) -> tuple[float, dict[str, float]] | None:
    """(weight, mean state of each element) of the heaviest assignment whose charges add up to zero.

    `states` has the (state, weight) that an element's atom may take; weights are added over atoms. Of
    equally heavy ones (to nine digits) that with the lowest charges in the order of elements. Charges are
    bounded, and of all ways to one charge only the heaviest goes on, so the search takes a step for each element and charge, not for each
    assignment. None where nothing balances, an element has no states, or there are more atoms than `sites`."""
    if not counts or sum(n for _, n in counts) > sites or any(n < 1 or not states.get(e) for e, n in counts):
        return None
    own = [_totals(n, states[e]) for e, n in counts]
    # rest[k]: the best weight of elements from k on for each charge that they have together
    rest: list[dict[int, float]] = [{0: 0.0}]
    low = [min(t) for t in own]
    high = [max(t) for t in own]
    for k in range(len(own) - 1, -1, -1):
        most, least = -sum(low[:k]), -sum(high[:k])
        now: dict[int, float] = {}
        for c, w in own[k].items():
            for d, v in rest[0].items():
                # what the elements before can't balance isn't followed
                if least <= c + d <= most and w + v > now.get(c + d, -math.inf):
                    now[c + d] = w + v
        rest.insert(0, now)
    if 0 not in rest[0]:
        return None
    charge, out = 0, {}
    for k, (element, n) in enumerate(counts):
        goal = rest[k][charge]
        c = min(c for c, w in own[k].items() if abs(w + rest[k + 1].get(charge - c, -math.inf) - goal) < 1e-9)
        out[element], charge = c / n, charge - c
    return rest[0][0], out


def oxidation_states(parts: DataFrame, key: str, states: DataFrame, sites: int = SITES) -> DataFrame:
    """(key, weight, oxidation): the heaviest states that balance each composition, as a map of elements to mean states.

    `parts` is (key, element, amount); amounts of one element are added up and divided by their greatest common divisor. `states` is
    (element, state, weight), the heaviest of equal states; it is a table of elements and goes to all tasks. Each distinct composition is
    searched once and joined back. Both are null where nothing balances, an amount isn't a whole number above 0 or an element isn't known, and beyond `sites` atoms."""
    known: dict[str, list[tuple[int, float]]] = {}
    # a few states of each of some hundred elements
    for r in states.groupBy("element", "state").agg(F.max("weight").alias("weight")).orderBy("element", "state").limit(100_000).collect():
        known.setdefault(r["element"], []).append((int(r["state"]), float(r["weight"])))
    some = parts.groupBy(key, "element").agg(F.sum("amount").cast("double").alias("amount"), F.count_if(F.col("amount").isNull()).alias("gaps"))
    held = some.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("element", "amount"))).alias("o"), F.sum("gaps").alias("gaps"), F.count_if(F.col("element").isNull()).alias("nameless"))
    whole = F.forall("o", lambda e: (e["amount"] == F.floor(e["amount"])) & (e["amount"] > 0) & (e["amount"] < 1e15))
    good = (F.col("gaps") == 0) & (F.col("nameless") == 0) & F.coalesce(whole, F.lit(False))
    amounts = F.transform("o", lambda e: e["amount"].cast("long"))
    held = held.withColumn("d", F.when(good, common_divisor(amounts)))
    composition: Column = F.transform("o", lambda e: F.concat_ws(":", e["element"], (e["amount"] / F.col("d")).cast("long").cast("string")))
    held = held.select(key, F.when(F.col("d").isNotNull(), F.array_join(composition, "\x1f")).alias("composition"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["composition"]:
                counts = [(e, int(n)) for e, n in (x.rsplit(":", 1) for x in text.split("\x1f"))]
                found = balanced_states(counts, known, sites)
                rows.append((text, *(found if found else (None, None))))
            yield pd.DataFrame(rows, columns=["composition", "weight", "oxidation"])

    distinct = held.filter("composition is not null").select("composition").distinct()
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = distinct.repartition(n, "composition").mapInPandas(search, "composition string, weight double, oxidation map<string, double>")
    return held.join(found, "composition", "left").select(key, "weight", "oxidation")
