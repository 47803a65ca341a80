"""Symmetry of structures, found from their atoms: primitive cells, operations that keep all atoms, crystal systems; densities.

Cells are (structure, lattice) and atoms (structure, atom, frac, species), as in `structures`. A structure's search needs all its
atoms at once, so it is one row of one task; structures are what spreads."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far an atom may be from where an operation puts it, and atoms up to which a structure is searched.
TOLERANCE, MOST = 0.01, 2000
#: Pairs of atoms that are compared at once.
AT_ONCE = 1 << 16
#: Crystal systems and their numbers.
SYSTEMS = {"triclinic": 0, "monoclinic": 1, "orthorhombic": 2, "tetragonal": 3, "trigonal": 4, "hexagonal": 5, "cubic": 6}
#: Cubic angstroms and atomic masses to grams a cubic centimetre.
GRAMS = 1.66053906660

_STEPS = np.array(list(itertools.product((-1, 0, 1), repeat=3)))


def reduced_cell(lattice: np.ndarray) -> np.ndarray:
    """Three short vectors of the same lattice: each is no longer than with any sum of the others taken off."""
    v = np.array(lattice, float)
    for _ in range(1000):
        v = v[np.argsort(np.einsum("ij,ij->i", v, v), kind="stable")]
        # the shorter two first, as in a plane, then the longest by all of their combinations near by
        k = round(float(v[1] @ v[0] / (v[0] @ v[0])))
        if k:
            v[1] -= k * v[0]
            continue
        near = np.linalg.lstsq(v[:2].T, v[2], rcond=None)[0]
        best = min((v[2] - (np.floor(near[0]) + a) * v[0] - (np.floor(near[1]) + b) * v[1] for a in (0, 1) for b in (0, 1)), key=lambda x: x @ x)
        if best @ best >= v[2] @ v[2] * (1 - 1e-9):
            return v
        v[2] = best
    return v


def _images(frac: np.ndarray) -> np.ndarray:
    return frac - np.round(frac)


def kept(moved: np.ndarray, frac: np.ndarray, kinds: np.ndarray, lattice: np.ndarray, tolerance: float) -> np.ndarray:
    """For each of several places that atoms are put to, (n, atoms, 3), whether they fall on atoms of their kind, each on one of its own."""
    out = np.ones(len(moved), bool)
    own = [np.flatnonzero(kinds == kind) for kind in dict.fromkeys(kinds.tolist())]
    step = max(1, AT_ONCE // len(frac) ** 2)
    for start in range(0, len(moved), step):
        some, good, taken = moved[start : start + step], out[start : start + step], np.zeros((len(moved[start : start + step]), len(frac)), bool)
        for mine in own:
            gap = _images(some[:, mine, None] - frac[mine]) @ lattice
            gap = np.einsum("nijx,nijx->nij", gap, gap)
            at = gap.argmin(axis=2)
            good &= (gap.min(axis=2) <= tolerance * tolerance).all(axis=1)
            taken[np.arange(len(some))[:, None], mine[at]] = True
        good &= taken.all(axis=1)
    return out


def _rarest(kinds: np.ndarray) -> np.ndarray:
    names, counts = np.unique(kinds, return_counts=True)
    return np.flatnonzero(kinds == names[np.argmin(counts)])


def translations(lattice: np.ndarray, frac: np.ndarray, kinds: np.ndarray, tolerance: float) -> np.ndarray:
    """Shifts, in parts of the cell, that keep all atoms; none first. They lead from one atom of the rarest kind to others."""
    rare, found = _rarest(kinds), []
    for some in _split(rare, AT_ONCE // len(frac) ** 2):
        shifts = frac[some] - frac[rare[0]]
        found.append(shifts[kept(frac + shifts[:, None], frac, kinds, lattice, tolerance)])
    return np.concatenate(found)


def _split(rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in blocks of that size, or one by one."""
    return [rows[i : i + max(1, size)] for i in range(0, len(rows), max(1, size))]


def _smallest(vectors: np.ndarray, volume: float) -> np.ndarray | None:
    """The first three vectors that span a cell of that volume, the last of them as early as can be, the others among the first 40."""
    a, b = np.triu_indices(min(len(vectors), 40), 1)
    across = np.cross(vectors[a], vectors[b])
    for block in _split(np.arange(2, len(vectors)), 64):
        fits = (np.abs(np.abs(across @ vectors[block].T) - volume) < 0.05 * volume) & (b[:, None] < block)
        some = fits.any(axis=0)
        if some.any():
            c = int(some.argmax())
            first = int(fits[:, c].argmax())
            return vectors[[a[first], b[first], block[c]]]
    return None


def primitive(lattice: np.ndarray, frac: np.ndarray, kinds: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cell, atoms, kinds, how many of it the given cell holds) of the smallest cell."""
    shifts = translations(lattice, frac, kinds, tolerance)
    if len(shifts) == 1:
        cell = reduced_cell(lattice)
    else:
        some = np.concatenate([_images(np.array(shifts))[:, None] + _STEPS[None], _STEPS[None]]).reshape(-1, 3) @ lattice
        some = some[np.argsort(np.linalg.norm(some, axis=1), kind="stable")]
        some = some[np.linalg.norm(some, axis=1) > tolerance]
        volume = abs(np.linalg.det(lattice)) / len(shifts)
        cell = _smallest(some, volume)
        if cell is None:
            return reduced_cell(lattice), frac @ lattice @ np.linalg.inv(reduced_cell(lattice)), kinds, 1
        cell = reduced_cell(cell)
    places = frac @ lattice @ np.linalg.inv(cell)
    kept: list[int] = []
    for i in range(len(places)):
        same = [k for k in kept if kinds[k] == kinds[i]]
        if not same or np.linalg.norm(_images(places[same] - places[i]) @ cell, axis=1).min() > 2 * tolerance:
            kept.append(i)
    return cell, places[kept], kinds[kept], len(shifts)


def rotations(cell: np.ndarray, tolerance: float) -> np.ndarray:
    """Whole-number matrices that turn a reduced cell's vectors into vectors as long and as far apart."""
    steps = _STEPS[np.any(_STEPS != 0, axis=1)]
    vectors, metric = steps @ cell, cell @ cell.T
    products = vectors @ vectors.T
    lengths = np.sqrt(products.diagonal())
    i, j, k = (np.flatnonzero(np.abs(lengths - math.sqrt(metric[n, n])) < tolerance) for n in range(3))
    room = 2 * tolerance * lengths.max()
    apart = lambda x, y, m: np.abs(products[np.ix_(x, y)] - m) < room
    fits = apart(i, j, metric[0, 1])[:, :, None] & apart(i, k, metric[0, 2])[:, None, :] & apart(j, k, metric[1, 2])
    a, b, c = np.nonzero(fits)
    turns = np.stack([steps[i[a]], steps[j[b]], steps[k[c]]], axis=1)
    return turns[np.abs(_determinants(turns)) == 1]


def _determinants(m: np.ndarray) -> np.ndarray:
    """Of whole-number matrices, exactly."""
    x, y, z = m[:, 0], m[:, 1], m[:, 2]
    return sum(x[:, i] * (y[:, (i + 1) % 3] * z[:, (i + 2) % 3] - y[:, (i + 2) % 3] * z[:, (i + 1) % 3]) for i in range(3))


def operations(cell: np.ndarray, frac: np.ndarray, kinds: np.ndarray, tolerance: float) -> np.ndarray:
    """Of a primitive cell's rotations, those that with some shift keep all atoms."""
    rare, turns = _rarest(kinds), rotations(cell, tolerance)
    good = np.zeros(len(turns), bool)
    # all shifts of as many rotations as are compared at once; of one, some after others until one is found
    for some in _split(np.arange(len(turns)), AT_ONCE // (len(rare) * len(frac) ** 2)):
        moved = frac @ turns[some]
        for j in _split(rare, AT_ONCE // (len(some) * len(frac) ** 2)):
            put = moved[:, None] + (frac[j] - moved[:, None, rare[0]])[:, :, None]
            good[some] |= kept(put.reshape(-1, *frac.shape), frac, kinds, cell, tolerance).reshape(len(some), -1).any(axis=1)
            if good[some].all():
                break
    return turns[good]


def crystal_system(turns: np.ndarray) -> str:
    """From how often each kind of axis comes among the operations, inversions taken off."""
    folds = {3: 1, -1: 2, 0: 3, 1: 4, 2: 6}
    proper = (turns * _determinants(turns)[:, None, None]).reshape(-1, 9)
    n = {k: 0 for k in folds.values()}
    for t in set(map(tuple, proper.tolist())):
        n[folds[t[0] + t[4] + t[8]]] += 1
    if n[3] == 8:
        return "cubic"
    if n[6]:
        return "hexagonal"
    if n[3]:
        return "trigonal"
    if n[4]:
        return "tetragonal"
    return "orthorhombic" if n[2] == 3 else "monoclinic" if n[2] == 1 else "triclinic"


def symmetry_of(lattice: np.ndarray, frac: np.ndarray, kinds: np.ndarray, tolerance: float = TOLERANCE) -> tuple[str, int, bool, int]:
    """(crystal system, operations of the given cell, whether it has an inversion, primitive cells in it)."""
    cell, places, some, times = primitive(lattice, frac, kinds, tolerance)
    turns = operations(cell, places, some, tolerance)
    return crystal_system(turns), len(turns) * times, bool((turns == -np.eye(3)).all(axis=(1, 2)).any()), times


FOUND = "structure {}, crystal_system string, crystal_system_id int, n_operations int, centrosymmetric boolean, primitive_cells int"


def symmetries(cells: DataFrame, atoms: DataFrame, tolerance: float = TOLERANCE, most: int = MOST) -> DataFrame:
    """(structure, crystal_system, crystal_system_id, n_operations, centrosymmetric, primitive_cells) of structures with atoms.

    Operations turn a structure so that every atom falls on one of its species within `tolerance`; their axes tell the system. All are
    null for cells without a volume, coordinates or species that are null, and more atoms than `most`: those are unknown."""
    held = atoms.groupBy("structure").agg(F.array_sort(F.collect_list(F.struct("atom", F.col("frac").cast("array<double>").alias("frac"), F.col("species").cast("string").alias("species")))).alias("o"))
    rows = cells.select("structure", F.col("lattice").cast("array<array<double>>").alias("lattice")).join(held, "structure")
    rows = rows.select("structure", "lattice", F.col("o.frac").alias("frac"), F.col("o.species").alias("species"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for structure, lattice, frac, species in batch.itertuples(index=False):
                out.append((structure, *_told(lattice, frac, species, tolerance, most)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")]).astype({"crystal_system_id": "Int32", "n_operations": "Int32", "primitive_cells": "Int32"})

    # a search is long for how short its row is: rows go to as many tasks as a shuffle has, whatever their bytes. Dealt by the
    # key of the sums above, Spark would leave this shuffle out and join that one's small parts to one task
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, F.xxhash64("structure")).mapInPandas(find, FOUND.format(dict(cells.dtypes)["structure"]))


def _told(lattice, frac, species, tolerance: float, most: int) -> tuple:
    unknown = (None,) * 5
    whole = lambda x, n: x is not None and len(x) == n and all(v is not None and np.isfinite(v) for v in x)
    if lattice is None or len(lattice) != 3 or not all(whole(v, 3) for v in lattice) or not all(whole(f, 3) for f in frac) or any(s is None for s in species) or len(frac) > most:
        return unknown
    cell = np.array([list(v) for v in lattice], float)
    if abs(np.linalg.det(cell)) < 1e-9:
        return unknown
    system, n, inverse, times = symmetry_of(cell, np.array([list(f) for f in frac], float), np.array(list(species)), tolerance)
    return system, SYSTEMS[system], n, inverse, times


def densities(cells: DataFrame, atoms: DataFrame, table: DataFrame) -> DataFrame:
    """(structure, density, volume_per_atom, packing): grams a cubic centimetre, and the share that atoms fill as balls.

    `table` is (element, mass, radius). What needs a mass or a radius that isn't known is null."""
    known = table.groupBy(F.col("element").alias("species")).agg(F.min("mass").cast("double").alias("mass"), F.min("radius").cast("double").alias("radius"))
    ball = F.lit(4 / 3 * math.pi) * F.pow("radius", F.lit(3.0))
    sums = atoms.join(known, "species", "left").groupBy("structure").agg(
        F.count("*").alias("n"), F.when(F.count("mass") == F.count("*"), F.sum("mass")).alias("m"), F.when(F.count("radius") == F.count("*"), F.sum(ball)).alias("b")
    )
    v = [[F.get(F.get("lattice", i), j).cast("double") for j in range(3)] for i in range(3)]
    volume = F.abs(sum((v[0][i] * (v[1][(i + 1) % 3] * v[2][(i + 2) % 3] - v[1][(i + 2) % 3] * v[2][(i + 1) % 3]) for i in range(1, 3)), v[0][0] * (v[1][1] * v[2][2] - v[1][2] * v[2][1])))
    out = cells.select("structure", volume.alias("v")).join(sums, "structure")
    return out.select("structure", (F.col("m") * GRAMS / F.col("v")).alias("density"), (F.col("v") / F.col("n")).alias("volume_per_atom"), (F.col("b") / F.col("v")).alias("packing"))
