"""Periodic neighbours, SOAP spectra, moments that relax and oxidation states against naive versions."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import lookups, relaxation, structures
from plumbline.plans.queries import QUERIES

CELLS = {"cubic": np.eye(3) * 3.0, "skew": np.array([[3, 0, 0], [2.2, 2.5, 0], [-1.1, 0.7, 4]]), "thin": np.array([[1.5, 0, 0], [0, 9, 0], [0.3, 0.2, 6]])}
ATOMS = [(s, i, (np.random.default_rng(len(s) * 10 + i).random(3) * 4 - 2).tolist()) for s in CELLS for i in range(3)] + [("lost", 0, [0.1, 0.2, 0.3])]


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def small_cells(n, atoms):
    r = np.random.default_rng(n)
    return {f"s{i:03}": CELLS["skew"] + r.random((3, 3)) / 4 for i in range(n)}, [(f"s{i:03}", a, (r.random(3) * 3 - 1).tolist()) for i in range(n) for a in range(atoms)]


def frames(spark, cells=CELLS, atoms=ATOMS):
    cell = spark.createDataFrame([(s, np.asarray(m, float).tolist()) for s, m in cells.items()], "structure string, lattice array<array<double>>")
    return cell, spark.createDataFrame(atoms, "structure string, atom int, frac array<double>")


def naive_neighbours(cells, atoms, radius, reach=9):
    """All others of each atom within the radius, nearest first, by trying every image."""
    shifts, out = list(itertools.product(range(-reach, reach + 1), repeat=3)), {}
    for s, i, f in atoms:
        if s in cells:
            found = []
            for _, j, g in (a for a in atoms if a[0] == s):
                x = np.linalg.norm((np.array(g) + np.array(shifts) - np.array(f)) @ np.asarray(cells[s], float), axis=1)
                found += [(round(float(d), 9), j, n) for d, n in zip(x, shifts) if d <= radius and (i != j or any(n))]
            out[s, i] = sorted(found)
    return out


@pytest.mark.parametrize("radius,k,cell", [(4.5, 12, lookups.CELL), (3.0, 5, 3)])
def test_periodic_neighbours(spark, monkeypatch, radius, k, cell):
    monkeypatch.setattr(lookups, "CELL", cell)
    got = {}
    for r in structures.periodic_neighbours(*frames(spark), radius, k).orderBy("place").collect():
        got.setdefault((r.structure, r.atom), []).append((round(r.distance, 9), r.other, tuple(r.image)))
    want = naive_neighbours(CELLS, ATOMS, radius)
    assert got == {a: n[:k] for a, n in want.items() if n}


def test_neighbours_do_not_depend_on_where_atoms_are_given(spark):
    """An atom given a cell farther has the same neighbours, its images counted from there."""
    moved = [(s, i, [x + (i == 1) * n for x, n in zip(f, (2, -1, 3))]) for s, i, f in ATOMS]
    both = [structures.periodic_neighbours(*frames(spark, atoms=a), 3.5, 6).select("structure", "atom", F.round("distance", 7).alias("d")).orderBy("structure", "atom", "d").collect() for a in (ATOMS, moved)]
    assert both[0] == both[1] and structures.periodic_neighbours(*frames(spark)[:1], frames(spark)[1].limit(0)).count() == 0


@pytest.mark.parametrize("name,most", [("WHOLE", 0), ("WHOLE", 3), ("AROUND", 900), ("PAIRS", 7)])
def test_whole_structures_and_others_have_the_same_neighbours(spark, monkeypatch, name, most):
    monkeypatch.setattr(structures, name, most)
    cells, atoms = small_cells(5, 3)
    atoms = [*atoms, *((s, 3 + i, [0.3 * i, 0.1, 2.7]) for s in ("s001", "s003") for i in range(2)), ("s004", 4000, [0.2, -0.9, 0.4])]
    got = {}
    for r in structures.periodic_neighbours(*frames(spark, cells, [*atoms, ("s000", 3, [None, 0.1, 0.1])]), 3.0, 7).orderBy("place").collect():
        got.setdefault((r.structure, r.atom), []).append((round(r.distance, 9), r.other, tuple(r.image)))
    assert got == {a: n[:7] for a, n in naive_neighbours(cells, atoms, 3.0, 5).items()}


@pytest.mark.parametrize("whole", [256, 0])
def test_distances_that_agree_with_the_radius_are_within_it(spark, monkeypatch, whole):
    """3 * 1.1 is 3.3000000000000003."""
    monkeypatch.setattr(structures, "WHOLE", whole, raising=False)
    found = structures.periodic_neighbours(*frames(spark, {"s": np.eye(3) * 1.1}, [("s", 0, [0.0, 0.0, 0.0])]), 3.3, 200)
    assert found.filter(F.round("distance", 9) == 3.3).count() == 30 and found.count() == 122


def test_neighbours_shuffle_atoms_not_images(spark, sf):
    before = shuffled(spark)
    assert QUERIES["periodic_neighbours"](spark, sf).agg(F.max("place")).first()[0] == 12
    assert shuffled(spark) - before < 60 * 15_000


def naive_soap(cells, atoms, r_cut, n_max, l_max, sigma):
    """Spectra atom by atom: expansions from neighbours one by one, products written out."""
    reach, out = r_cut + sigma * math.sqrt(-2 * math.log(structures.TAIL)), {}
    for s, m in cells.items():
        mine = [np.array(f) for t, _, f in atoms if t == s]
        spectra = []
        for f in mine:
            c = np.zeros((n_max, (l_max + 1) ** 2))
            for g in mine:
                for n in itertools.product(range(-12, 13), repeat=3):
                    x = (g + np.array(n) - f) @ np.asarray(m, float)
                    if np.linalg.norm(x) <= reach:
                        c += structures.density_coefficients(x[None], n_max, l_max, r_cut, sigma)[0]
            p = []
            for a in range(n_max):
                for b in range(a, n_max):
                    for l in range(l_max + 1):
                        p.append(math.pi * math.sqrt(8 / (2 * l + 1)) * sum(c[a, k] * c[b, k] for k in range(l * l, (l + 1) ** 2)))
            spectra.append(p)
        out[s] = np.mean(spectra, axis=0)
    return out


def test_soap_is_the_naive_one_and_turns_with_nothing(spark):
    settings = (3.0, 3, 2, 0.4)
    got = {r.structure: (r.n_atoms, np.array(r.soap)) for r in structures.soap_block(*frames(spark), *settings).collect()}
    want = naive_soap(CELLS, ATOMS, *settings)
    assert got.keys() == want.keys() and all(n == 3 and v == pytest.approx(want[s], rel=1e-9) for s, (n, v) in got.items())
    turn, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((3, 3)))
    turned = structures.soap_block(*frames(spark, {s: np.asarray(m, float) @ turn for s, m in CELLS.items()}), *settings)
    assert all(np.array(r.soap) == pytest.approx(got[r.structure][1], rel=1e-9) for r in turned.collect())


def test_soap_shuffles_atoms_not_expansions(spark):
    """An expansion is 392 numbers; of a structure that fits in a task only its atoms go through a shuffle."""
    cells, atoms = small_cells(40, 6)
    given, before = frames(spark, cells, atoms), shuffled(spark)
    assert len(structures.soap_block(*given, 3.0, 8, 6, 0.5).collect()) == 40
    assert shuffled(spark) - before < 400 * len(atoms)


def test_soap_lowest_shuffles_little(spark, sf):
    """Orders are numbered and gathered: some 60 bytes each at most."""
    before = shuffled(spark)
    assert QUERIES["soap_lowest"](spark, sf).agg(F.sum("n_atoms")).first()[0] == 15_000
    assert shuffled(spark) - before < 60 * 15_000


@pytest.mark.parametrize("name,most", [("WHOLE", 0), ("WHOLE", 3), ("AROUND", 900), ("PAIRS", 7)])
def test_whole_structures_and_others_have_the_same_spectra(spark, monkeypatch, name, most):
    cells, atoms = small_cells(5, 3)
    atoms = [*atoms, *((s, 3 + i, [0.3 * i, 0.1, 0.7]) for s in ("s001", "s003") for i in range(2)), ("s004", 4000, [0.2, 0.9, 0.4]), ("s000", 3, [None, 0.1, 0.1])]
    want = {r.structure: r for r in structures.soap_block(*frames(spark, cells, atoms), 3.0, 3, 2, 0.4).collect()}
    assert {s: r.n_atoms for s, r in want.items()} == {"s000": 3, "s001": 5, "s002": 3, "s003": 5, "s004": 4}
    monkeypatch.setattr(structures, name, most)
    got = structures.soap_block(*frames(spark, cells, atoms), 3.0, 3, 2, 0.4).collect()
    assert len(got) == 5 and all(r.n_atoms == want[r.structure].n_atoms and r.soap == pytest.approx(want[r.structure].soap, rel=1e-9) for r in got)


def test_soap_has_the_columns_of_its_contract(spark):
    one = {"cubic": CELLS["cubic"]}
    row = structures.soap_block(*frames(spark, one, [("cubic", 0, [0.0, 0.0, 0.0])]), 4.0).first()
    assert len(row.soap) == 252 and np.isfinite(row.soap).all() and row.n_atoms == 1
    with pytest.raises(ValueError):
        structures.soap_block(*frames(spark), r_cut=0.5)


def test_expansions_are_integrals():
    """The closed form against sums over a fine grid; radial functions are orthonormal."""
    n_max, l_max, r_cut, sigma = 3, 2, 4.0, 0.6
    alphas, mixtures = structures.radial_basis(n_max, l_max, r_cut)
    g = np.arange(-8, 8, 0.2)
    x = np.stack(np.meshgrid(g, g, g, indexing="ij"), -1).reshape(-1, 3)
    centre, r2, harmonics = np.array([0.7, -1.1, 0.5]), np.sum(x * x, axis=1), structures.solid_harmonics(x, l_max)
    density = np.exp(-np.sum((x - centre) ** 2, axis=1) / (2 * sigma**2))
    want = np.zeros((n_max, (l_max + 1) ** 2))
    for l in range(l_max + 1):
        radial = np.exp(-np.outer(r2, alphas[l])) @ mixtures[l].T
        want[:, l * l : (l + 1) ** 2] = np.einsum("pn,pm,p->nm", radial, harmonics[:, l * l : (l + 1) ** 2], density) * 0.2**3
        r = np.linspace(0, 30, 30_001)
        f = np.exp(-np.outer(alphas[l], r**2)) * r**l
        f = mixtures[l] @ f
        assert (f * r**2) @ f.T * (r[1] - r[0]) == pytest.approx(np.eye(n_max), abs=1e-6)
    assert structures.density_coefficients(centre[None], n_max, l_max, r_cut, sigma)[0] == pytest.approx(want, abs=1e-9)


# moments

HOW = relaxation.Descent()


def counted(energy):
    seen = []

    def of(m):
        seen.append(np.array(m))
        return energy(m)

    return of, seen


@pytest.mark.parametrize("seed", range(8))
def test_descent_of_a_quadratic(seed):
    r = np.random.default_rng(seed)
    half = r.standard_normal((6, 6))
    a, goal = half @ half.T + np.eye(6), r.standard_normal(6)
    energy, seen = counted(lambda m: (0.5 * (m - goal) @ a @ (m - goal), a @ (m - goal)))
    at, value, gradient, path = relaxation.descend(energy, np.zeros(6))
    assert np.max(np.abs(gradient)) < HOW.flat and at == pytest.approx(goal, abs=0.05) and all(b < x for x, b in zip(path, path[1:]))
    assert max(np.max(np.abs(b - x)) for x, b in zip(seen, seen[1:])) <= 2 * HOW.farthest + 1e-12


def test_descent_of_coupled_sites():
    """A ring of sites that each prefer |m| = 1: alike with positive couplings, in turn with negative ones."""
    for coupling, kind in ((0.3, np.ones(8)), (-0.3, np.tile([1, -1], 4))):
        energy = relaxation.site_energy([(-1.0, 0.5, 0.0)] * 8, [(i, (i + 1) % 8, coupling) for i in range(8)])
        at, value, _, path = relaxation.descend(energy, 0.2 * kind)
        # -2 m + 2 m^3 = 2 |J| m for each site
        size = math.sqrt(1 + abs(coupling))
        assert at == pytest.approx(size * kind, abs=0.01) and value == pytest.approx(8 * (-(size**2) + 0.5 * size**4 - abs(coupling) * size**2), abs=1e-3)
        assert all(b < x for x, b in zip(path, path[1:])) and len(path) - 1 >= (size - 0.2) / HOW.farthest - 1


def test_gradients_are_those_of_energies():
    r = np.random.default_rng(1)
    energy, m, e = relaxation.site_energy(r.standard_normal((5, 3)), [(0, 1, 0.5), (1, 2, -0.2), (4, 0, 1.5), (0, 1, 0.1)]), r.standard_normal(5), 1e-6
    slope = [(energy(m + e * d)[0] - energy(m - e * d)[0]) / (2 * e) for d in np.eye(5)]
    assert energy(m)[1] == pytest.approx(slope, abs=1e-6)


def test_descent_ends():
    cliff = relaxation.descend(lambda m: (math.nan if np.any(m > 0.01) else -float(m.sum()), -np.ones_like(m)), np.zeros(2))
    assert np.all(cliff[0] <= 0.01) and len(cliff[3]) <= HOW.steps + 1
    wrong = relaxation.descend(lambda m: (float(m @ m), -2 * m), np.ones(2))
    assert wrong[3] == [2.0] and list(wrong[0]) == [1, 1]
    endless = relaxation.descend(lambda m: (-float(m.sum()), -np.ones_like(m)), np.zeros(1))
    assert len(endless[3]) == HOW.steps + 1 and endless[0][0] <= HOW.steps * HOW.farthest + 1e-9
    assert relaxation.descend(lambda m: (0.0, m), np.zeros(0))[3] == [0.0]


def test_relaxed_structures_and_their_status(spark):
    rows = [
        (1, [[0.1, 0.2, 0.0]] * 3, ["Fe"] * 3, "harmonic"), (2, [[0.0, 0.0, 0.0]], ["Fe"], "endless"), (3, [[0.0, 0.0, 4.0]], ["O"], "harmonic"),
        (4, [], [], "harmonic"), (5, None, None, "harmonic"), (6, [[0.0, 0.0, 1.0]], ["Fe"], "broken"),
    ]
    frame = spark.createDataFrame(rows, "structure long, moments array<array<double>>, symbols array<string>, kind string").withColumn("limits", F.create_map(F.lit("Fe"), F.lit(30.0), F.lit("O"), F.lit(0.5)))

    def make():
        kinds = {"harmonic": relaxation.site_energy([(0.5, 0.0, 1.0)] * 3, []), "broken": lambda m: (math.nan, m)}
        one = relaxation.site_energy([(0.5, 0.0, 1.0)], [])
        return lambda row: (lambda m: (-float(m.sum()), -np.ones_like(m))) if row["kind"] == "endless" else one if row["kind"] == "harmonic" and len(row["moments"]) == 1 else kinds[row["kind"]]

    got = {r.structure: r for r in relaxation.relaxed(frame, make).collect()}
    assert got[1].status == "ok" and [m[2] for m in got[1].moments] == pytest.approx([1.0] * 3, abs=0.02) and got[1].moments[0][:2] == [0.1, 0.2] and got[1].reasons == []
    assert got[2].status == "warning_not_converged" and got[2].steps == HOW.steps and len(got[2].reasons) == 1
    assert got[3].status == "invalid" and "limit" in got[3].reasons[0]
    assert {got[i].status for i in (4, 5, 6)} == {"invalid"} and relaxation.relaxed(frame.limit(0), make).count() == 0


# oxidation states


def every_assignment(counts, states):
    """The best of all assignments, each written out."""
    best, own = None, [list(itertools.combinations_with_replacement(states[e], n)) for e, n in counts]
    for chosen in itertools.product(*own):
        charges = [sum(s for s, _ in c) for c in chosen]
        if sum(charges) == 0:
            told = (-round(sum(w for c in chosen for _, w in c), 9), charges)
            best = told if best is None else min(best, told)
    return best and (-best[0], {e: c / n for (e, n), c in zip(counts, best[1])})


@pytest.mark.parametrize("seed", range(30))
def test_balanced_states(seed):
    r = np.random.default_rng(seed)
    states = {e: [(int(s), float(np.round(r.random(), 2))) for s in r.choice(range(-4, 6), r.integers(1, 4), replace=False)] for e in "ABCD"}
    counts = [(e, int(r.integers(1, 4))) for e in "ABCD"[: r.integers(1, 5)]]
    got, want = relaxation.balanced_states(counts, states), every_assignment(counts, states)
    assert (got is None) == (want is None) and (got is None or (got[0] == pytest.approx(want[0]) and got[1] == want[1]))


def test_hostile_compositions_end():
    states = {f"E{i}": [(s, 0.1 + (s % 3) / 10 + i / 1000) for s in range(-4, 8)] for i in range(20)}
    began = time.perf_counter()
    weight, found = relaxation.balanced_states([(e, 13 + i % 7) for i, e in enumerate(states)], states)
    assert abs(sum(found[e] * (13 + i % 7) for i, e in enumerate(states))) < 1e-6 and time.perf_counter() - began < 20
    assert relaxation.balanced_states([("E0", relaxation.SITES + 1)], states) is None and relaxation.balanced_states([], states) is None


def test_oxidation_states_of_tables(spark):
    states = spark.createDataFrame([("Fe", 2, 0.4), ("Fe", 3, 0.5), ("Fe", 3, 0.2), ("O", -2, 0.9), ("Cl", -1, 0.8)], "element string, state int, weight double")
    parts = [("a", "Fe", 4.0), ("a", "O", 6.0), ("b", "Fe", 3.0), ("b", "O", 4.0), ("c", "Fe", 1.0), ("d", "Xx", 1.0), ("d", "O", 1.0), ("e", "Fe", 0.5), ("e", "O", 1.0), ("f", "Fe", None), ("g", None, 1.0), ("h", "Fe", 1.0), ("h", "O", 0.5), ("h", "O", 0.5), ("i", "O", -1.0)]
    frame = spark.createDataFrame(parts, "k string, element string, amount double")
    got = {r.k: r.oxidation for r in relaxation.oxidation_states(frame, "k", states).collect()}
    assert got.pop("b") == pytest.approx({"Fe": 8 / 3, "O": -2.0})
    assert got == {"a": {"Fe": 3.0, "O": -2.0}, "h": {"Fe": 2.0, "O": -2.0}} | dict.fromkeys("cdefgi")
    assert relaxation.oxidation_states(frame.limit(0), "k", states).count() == 0
