"""Known crystals of the seven systems, turned, re-based, shifted and doubled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import symmetry as Y
from plumbline.plans.queries import QUERIES


def cell(a, b, c, alpha=90, beta=90, gamma=90):
    x, y, z = np.cos(np.radians([alpha, beta, gamma]))
    s = np.sin(np.radians(gamma))
    top = (x - y * z) / s
    return np.array([[a, 0, 0], [b * z, b * s, 0], [c * y, c * top, c * np.sqrt(1 - y * y - top * top)]])


FCC = [[0, 0, 0], [0, 0.5, 0.5], [0.5, 0, 0.5], [0.5, 0.5, 0]]
SALT = (cell(5.6, 5.6, 5.6), FCC + [[x + 0.5, y, z] for x, y, z in FCC], ["Na"] * 4 + ["Cl"] * 4)
#: name -> ((lattice, coordinates, species), system, operations of the given cell, inversion, primitive cells)
KNOWN = {
    "salt": (SALT, "cubic", 192, True, 4),
    "caesium chloride": ((cell(4.1, 4.1, 4.1), [[0, 0, 0], [0.5, 0.5, 0.5]], ["Cs", "Cl"]), "cubic", 48, True, 1),
    "iron": ((cell(2.9, 2.9, 2.9), [[0, 0, 0], [0.5, 0.5, 0.5]], ["Fe", "Fe"]), "cubic", 96, True, 2),
    "zincblende": ((cell(5.4, 5.4, 5.4), FCC + [[x + 0.25, y + 0.25, z + 0.25] for x, y, z in FCC], ["Zn"] * 4 + ["S"] * 4), "cubic", 96, False, 4),
    "rutile": ((cell(4.6, 4.6, 2.95), [[0, 0, 0], [0.5, 0.5, 0.5], [0.305, 0.305, 0], [-0.305, -0.305, 0], [0.805, 0.195, 0.5], [0.195, 0.805, 0.5]], ["Ti"] * 2 + ["O"] * 4), "tetragonal", 16, True, 1),
    "magnesium": ((cell(3.2, 3.2, 5.2, gamma=120), [[1 / 3, 2 / 3, 0.25], [2 / 3, 1 / 3, 0.75]], ["Mg"] * 2), "hexagonal", 24, True, 1),
    "wurtzite": ((cell(3.8, 3.8, 6.2, gamma=120), [[1 / 3, 2 / 3, 0], [2 / 3, 1 / 3, 0.5], [1 / 3, 2 / 3, 0.38], [2 / 3, 1 / 3, 0.88]], ["Zn"] * 2 + ["S"] * 2), "hexagonal", 12, False, 1),
    "calomel iodide": ((cell(4.2, 4.2, 6.8, gamma=120), [[0, 0, 0], [1 / 3, 2 / 3, 0.25], [2 / 3, 1 / 3, 0.75]], ["Cd", "I", "I"]), "trigonal", 12, True, 1),
    "rhombohedral": ((cell(4.7, 4.7, 4.7, 57, 57, 57), [[0.22] * 3, [-0.22] * 3], ["Bi"] * 2), "trigonal", 12, True, 1),
    "plain box": ((cell(3, 4, 5), [[0, 0, 0]], ["X"]), "orthorhombic", 8, True, 1),
    "centred face": ((cell(3, 4, 5), [[0, 0, 0], [0.5, 0.5, 0]], ["X", "X"]), "orthorhombic", 16, True, 2),
    "leaning": ((cell(3, 4, 5, beta=103), [[0, 0, 0], [0.2, 0, 0.4]], ["A", "B"]), "monoclinic", 2, False, 1),
    "leaning, alone": ((cell(3, 4, 5, beta=103), [[0.1, 0.2, 0.3]], ["A"]), "monoclinic", 4, True, 1),
    "crooked": ((cell(3, 4, 5, 80, 97, 103), [[0, 0, 0], [0.21, 0.34, 0.4], [0.7, 0.1, 0.25]], ["A", "B", "C"]), "triclinic", 1, False, 1),
    "crooked, inverted": ((cell(3, 4, 5, 80, 97, 103), [[0, 0, 0]], ["A"]), "triclinic", 2, True, 1),
}


@pytest.mark.parametrize("name", list(KNOWN))
def test_known_crystals(name):
    (lattice, frac, species), *want = KNOWN[name]
    lattice, frac, species = np.array(lattice), np.array(frac, float), np.array(species)
    assert list(Y.symmetry_of(lattice, frac, species)) == want
    r = np.random.default_rng(len(name))
    turn, _ = np.linalg.qr(r.standard_normal((3, 3)))
    base = np.array([[1, 1, 0], [0, 1, 0], [2, 1, 1]])
    # the same crystal turned, from another origin, by other vectors of its lattice, its atoms in another order
    order = r.permutation(len(frac))
    moved = ((frac + r.random(3)) @ np.linalg.inv(base))[order] + r.integers(-2, 3, (len(frac), 3))
    assert list(Y.symmetry_of(base @ lattice @ turn, moved, species[order])) == want
    # two cells taken as one
    double = np.diag([1, 1, 2]) @ lattice, np.concatenate([frac, frac + [0, 0, 1]]) / [1, 1, 2], np.tile(species, 2)
    assert list(Y.symmetry_of(*double)) == [want[0], want[1] * 2, want[2], want[3] * 2]


def test_moved_atoms_lower_the_symmetry():
    (lattice, frac, species), *_ = KNOWN["caesium chloride"]
    bent = np.array(frac, float) + [[0, 0, 0], [0.02, 0, 0]]
    assert Y.symmetry_of(lattice, bent, np.array(species))[0] == "tetragonal" and Y.symmetry_of(lattice, bent, np.array(species), tolerance=0.2)[0] == "cubic"


def test_tables(spark):
    cells = [(n, np.asarray(k[0][0]).tolist()) for n, k in KNOWN.items()] + [("flat", [[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 0.0, 1.0]]), ("gap", np.eye(3).tolist()), ("empty", np.eye(3).tolist())]
    atoms = [(n, i, [float(x) for x in f], s) for n, k in KNOWN.items() for i, (f, s) in enumerate(zip(k[0][1], k[0][2]))] + [("flat", 0, [0.0] * 3, "A"), ("gap", 0, [0.0, None, 0.0], "A")]
    c, a = spark.createDataFrame(cells, "structure string, lattice array<array<double>>"), spark.createDataFrame(atoms, "structure string, atom int, frac array<double>, species string")
    got = {r.structure: r for r in Y.symmetries(c, a).collect()}
    assert {n: [r.crystal_system, r.n_operations, r.centrosymmetric, r.primitive_cells] for n, r in got.items()} == {n: list(k[1:]) for n, k in KNOWN.items()} | {"flat": [None] * 4, "gap": [None] * 4}
    assert all(r.crystal_system_id == Y.SYSTEMS.get(r.crystal_system) for r in got.values())
    assert all(r.crystal_system is None for r in Y.symmetries(c, a, most=0).collect()) and Y.symmetries(c, a.limit(0)).count() == 0
    table = spark.createDataFrame([("Na", 22.99, 1.8), ("Cl", 35.45, 1.0), ("X", 10.0, None)], "element string, mass double, radius double")
    d = {r.structure: r for r in Y.densities(c, a, table).collect()}
    assert d["salt"].density == pytest.approx(4 * 58.44 * Y.GRAMS / 5.6**3) and d["salt"].volume_per_atom == pytest.approx(5.6**3 / 8)
    assert d["salt"].packing == pytest.approx(4 * 4 / 3 * np.pi * (1.8**3 + 1) / 5.6**3) and d["plain box"].packing is None and d["rutile"].density is None


def test_searches_are_dealt_to_all_tasks(spark, sf):
    """However few bytes they have: a search is long for its row."""
    found = QUERIES["crystal_systems"](spark, sf).groupBy(F.spark_partition_id().alias("task")).agg(F.count("crystal_system").alias("n")).collect()
    assert len(found) == 4 and sum(r.n for r in found) == 1500 and max(r.n for r in found) < 500


def test_many_places_at_once():
    """Whether atoms are kept, one place after the other: each on one of its own kind, no two on the same."""
    lattice, frac, kinds = np.eye(3) * 4, np.array([[0, 0, 0], [0.5, 0.5, 0], [0.5, 0, 0.5]]), np.array(["A", "A", "B"])
    moved = np.array([frac, frac[[1, 0, 2]], frac[[0, 0, 2]], frac[[2, 1, 0]], frac + 0.001, frac + 0.01, frac - [3, 0, 7]])
    assert Y.kept(moved, frac, kinds, lattice, 0.01).tolist() == [True, True, False, False, True, False, True]
