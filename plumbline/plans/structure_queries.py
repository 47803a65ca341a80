"""Registered queries over structures derived from the driver's tables: customers are skewed cells and their orders atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph_networks, networks, relaxation, structures, symmetry
from ..sources.shared import Held
from .registry import query, rounded, t

CELLS_SQL = """c AS (SELECT c_custkey s, 3 + c_custkey % 3 ax, (c_custkey % 5) * 0.5::DOUBLE - 1 bx, 3.5::DOUBLE + c_custkey % 2 BY_, 0.3::DOUBLE * (c_custkey % 7) cx, -0.4::DOUBLE * (c_custkey % 2) cy, 4 + c_custkey % 3 cz FROM customer),
a AS (SELECT o_custkey s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 i, o_orderkey k, (o_orderkey % 97) / 97.0::DOUBLE u, (o_orderkey % 89) / 89.0::DOUBLE v, (o_orderkey % 83) / 83.0::DOUBLE w FROM orders)"""


def _cells(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    d = lambda x: x.cast("double")
    zero = F.lit(0.0)
    rows = ((d(3 + k % 3), zero, zero), (d(k % 5) * 0.5 - 1, 3.5 + d(k % 2), zero), (0.3 * d(k % 7), -0.4 * d(k % 2), d(4 + k % 3)))
    return t(spark, sf, "customer").select(k.alias("structure"), F.array(*(F.array(*r) for r in rows)).alias("lattice"))


def _atoms(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    frac = F.array(*((k % n).cast("double") / n for n in (97, 89, 83)))
    return t(spark, sf, "orders").select(F.col("o_custkey").alias("structure"), place.alias("atom"), k.alias("order"), frac.alias("frac"))


@query(
    f"""WITH {CELLS_SQL}, n AS (SELECT unnest(range(-2, 3)) n), g AS (SELECT p.n p, q.n q, r.n r FROM n p, n q, n r),
d AS (SELECT x.s, x.i atom, y.i other, p, q, r, y.u + p - x.u du, y.v + q - x.v dv, y.w + r - x.w dw FROM a x JOIN a y USING (s), g WHERE x.i <> y.i OR p <> 0 OR q <> 0 OR r <> 0),
e AS (SELECT s, atom, other, p, q, r, round(sqrt((du * ax + dv * bx + dw * cx) ** 2 + (dv * BY_ + dw * cy) ** 2 + (dw * cz) ** 2), 9) distance FROM d JOIN c USING (s)),
o AS (SELECT *, row_number() OVER (PARTITION BY s, atom ORDER BY distance, other, p, q, r) place FROM e WHERE distance <= 2.5)
SELECT s AS "structure", atom, other, p || ',' || q || ',' || r image, distance, place::INT place FROM o WHERE place <= 12"""
)
def periodic_neighbours(spark, sf):
    """The 12 nearest atoms within 2.5 of every atom, images over the borders of skewed cells among them."""
    found = structures.periodic_neighbours(_cells(spark, sf), _atoms(spark, sf), 2.5, 12)
    return rounded(found.withColumn("image", F.concat_ws(",", F.col("image").cast("array<string>"))).withColumn("other", F.col("other").cast("long")))


@query()
def soap_spectra(spark, sf):
    """252 columns of each cell, averaged over its atoms."""
    found = structures.soap_block(_cells(spark, sf), _atoms(spark, sf), 3.0, 8, 6, 0.5)
    return found.withColumn("soap", F.transform("soap", lambda x: F.round(x, 9)))


#: cutoff and width of the query below; its one radial function of each l falls to a thousandth at 1
CUT, WIDTH = 1.5, 0.3


@query(
    f"""WITH {CELLS_SQL}, n AS (SELECT unnest(range(-2, 3)) n), g AS (SELECT p.n p, q.n q, r.n r FROM n p, n q, n r),
d AS (SELECT x.s, x.i, y.u + p - x.u du, y.v + q - x.v dv, y.w + r - x.w dw FROM a x JOIN a y USING (s), g),
e AS (SELECT s, i, du * ax + dv * bx + dw * cx x, dv * BY_ + dw * cy y, dw * cz z FROM d JOIN c USING (s)),
k AS (SELECT ln(1000::DOUBLE) f, 1 / (2 * {WIDTH}::DOUBLE * {WIDTH}) b, {CUT} + {WIDTH} * sqrt(2 * ln(1000::DOUBLE)) reach),
w AS (SELECT s, i, x, y, z, pow(pi() / (b + f), 1.5) * exp(-b * f / (b + f) * (x * x + y * y + z * z)) h, b / (b + f) t, 1 / sqrt(0.25 * sqrt(pi()) * pow(2 * f, -1.5)) m0, 1 / sqrt(0.375 * sqrt(pi()) * pow(2 * f, -2.5)) m1
  FROM e, k WHERE sqrt(x * x + y * y + z * z) <= reach),
p AS (SELECT s, i, pi() * sqrt(8) * pow(sum(h * m0) / sqrt(4 * pi()), 2) p0, pi() * sqrt(8 / 3.0::DOUBLE) * 3 / (4 * pi()) * (pow(sum(h * t * m1 * x), 2) + pow(sum(h * t * m1 * y), 2) + pow(sum(h * t * m1 * z), 2)) p1 FROM w GROUP BY 1, 2)
SELECT s AS "structure", count(*) n_atoms, round(avg(p0), 6) p0, round(avg(p1), 6) p1 FROM p GROUP BY 1"""
)
def soap_lowest(spark, sf):
    """The spectra's first two invariants, which SQL can write out."""
    found = structures.soap_block(_cells(spark, sf), _atoms(spark, sf), CUT, 1, 1, WIDTH)
    return found.select("structure", "n_atoms", *(F.round(F.get("soap", i), 6).alias(f"p{i}") for i in range(2)))


def _harmonic():
    """Each site's moment prefers a size of its own: sum of (m - c)^2, without its constant."""
    return lambda row: relaxation.site_energy([(1.0, 0.0, 2.0 * float(c)) for c in row["preferred"]], [])


@query(
    f"""WITH {CELLS_SQL}, m AS (SELECT s, i, ((k % 9) - 4) * 0.1::DOUBLE c FROM a)
SELECT s AS "structure", string_agg(printf('%.1f', c + 0.0), ',' ORDER BY i) moments, 'ok' status, round(-sum(c * c), 2) + 0.0 energy FROM m GROUP BY s"""
)
def moment_relaxation(spark, sf):
    """Moments of each cell's sites relax from zero to what they prefer; a flat gradient is within 0.005 of it."""
    c = ((F.col("order") % 9) - 4).cast("double") * 0.1
    sites = _atoms(spark, sf).groupBy("structure").agg(F.array_sort(F.collect_list(F.struct("atom", c.alias("c")))).alias("o"))
    rows = sites.select(
        "structure", F.transform("o", lambda s: F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("moments"), F.transform("o", lambda s: F.lit("Fe")).alias("symbols"),
        F.create_map(F.lit("Fe"), F.lit(4.5)).alias("limits"), F.transform("o", lambda s: s["c"]).alias("preferred"),
    )
    found = relaxation.relaxed(rows, lambda: _harmonic())
    said = F.transform("moments", lambda m: F.format_string("%.1f", F.round(F.get(m, 2), 1) + F.lit(0.0)))
    return found.select("structure", F.concat_ws(",", said).alias("moments"), "status", (F.round("energy", 2) + F.lit(0.0)).alias("energy"))


#: element -> (state, weight) of the query below; the seventh is not known.
STATES = {1: [(-2, 0.9), (-1, 0.1)], 2: [(2, 0.6), (3, 0.35)], 3: [(1, 0.8)], 4: [(4, 0.5), (2, 0.3), (-4, 0.1)], 5: [(3, 0.7), (-3, 0.25)], 6: [(-1, 0.55), (5, 0.2), (7, 0.15)]}


def _states_sql() -> str:
    """For each element all totals of up to 24 atoms, then totals added element by element."""
    chain = ", ".join(f"o{m} AS (SELECT a.e, {m} m, a.total + b.total total, max(a.best + b.best) best FROM o{m - 1} a JOIN o1 b USING (e) GROUP BY 1, 3)" for m in range(2, 25))
    values = ", ".join(f"({e}, {s}, {w})" for e, some in STATES.items() for s, w in some)
    steps = ["t0 AS (SELECT k, 0 c, 0.0::DOUBLE w FROM (SELECT DISTINCT k FROM n))"]
    for e in range(1, 7):
        of = f"SELECT k, total, best FROM n JOIN totals USING (e, m) WHERE e = {e} UNION ALL SELECT k, 0, 0.0 FROM n GROUP BY k HAVING count_if(e = {e}) = 0"
        steps.append(f"t{e} AS (SELECT t.k, c + total c, max(w + best) w FROM t{e - 1} t JOIN ({of}) o ON o.k = t.k GROUP BY 1, 2)")
    return f"""WITH s(e, state, weight) AS (VALUES {values}),
p AS (SELECT l_orderkey k, l_linenumber e, sum(1 + l_quantity::BIGINT % 3)::BIGINT amount FROM lineitem GROUP BY 1, 2),
d AS (SELECT k, list_reduce(list(amount), lambda a, b: gcd(a, b)) d FROM p GROUP BY k), n AS MATERIALIZED (SELECT k, e, amount // d m FROM p JOIN d USING (k)),
o1 AS (SELECT e, 1 m, state total, weight::DOUBLE best FROM s), {chain}, totals AS ({' UNION ALL '.join(f'FROM o{m}' for m in range(1, 25))}),
{", ".join(steps)}
SELECT k, round(w, 6) weight FROM (SELECT DISTINCT k FROM n) LEFT JOIN (SELECT k, w FROM t6 WHERE c = 0 AND k NOT IN (SELECT k FROM n WHERE e = 7)) USING (k)"""


@query(_states_sql())
def oxidation_weights(spark, sf):
    """Orders as compositions of line numbers: the weight of the heaviest states that balance each, null where none do."""
    states = spark.createDataFrame([(str(e), s, w) for e, some in STATES.items() for s, w in some], "element string, state int, weight double")
    amount = 1 + F.col("l_quantity").cast("long") % 3
    parts = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("string").alias("element"), amount.alias("amount"))
    return rounded(relaxation.oxidation_states(parts, "k", states).select("k", "weight"), 6)


@query()
def network_scores(spark, sf):
    """A small head on all 64 numbers of a vector, trained on two thirds and chosen on the rest."""
    rows = t(spark, sf, "embeddings").select("vec_id", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") < 3).cast("int").alias("y"))
    part = F.pmod(F.xxhash64("id"), F.lit(3))
    half = max(2, rows.count() // 2)
    network, _ = networks.fit_network(rows.filter(part > 0), rows.filter(part == 0), networks.Settings(epochs=3, batch_size=half, learning_rate=0.01, hidden=(16,)))
    return network.scored(rows, "x").select("vec_id", F.round("score", 6).alias("score"))


#: lengths and angles of cells that each belong to one crystal system, sizes growing with the customer's account
SHAPES = [(3.1, 3.9, 4.7, 81, 97, 103), (3.1, 3.9, 4.7, 90, 104, 90), (3.1, 3.9, 4.7, 90, 90, 90), (3.1, 3.1, 4.7, 90, 90, 90), (3.1, 3.1, 3.1, 67, 67, 67), (3.1, 3.1, 4.7, 90, 90, 120), (3.1, 3.1, 3.1, 90, 90, 90)]


@query(
    """SELECT c_custkey AS "structure", ['triclinic', 'monoclinic', 'orthorhombic', 'tetragonal', 'trigonal', 'hexagonal', 'cubic'][c_custkey % 7 + 1] crystal_system, (c_custkey % 7)::INT crystal_system_id,
 ([2, 4, 8, 16, 12, 24, 48][c_custkey % 7 + 1] * (1 + c_custkey % 2))::INT n_operations, true centrosymmetric, (1 + c_custkey % 2)::INT primitive_cells FROM customer"""
)
def crystal_systems(spark, sf):
    """Cells of all seven systems with an atom at a corner; every second one is given twice as long, with two atoms."""
    k, size = F.col("c_custkey"), 1 + F.abs("c_acctbal") / 20_000
    shapes = F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in SHAPES))
    shape = F.get(shapes, (k % 7).cast("int"))
    x, y, z = (F.cos(F.radians(F.get(shape, i))) for i in (3, 4, 5))
    sine = F.sin(F.radians(F.get(shape, 5)))
    top = (x - y * z) / sine
    zero, (a, b, c) = F.lit(0.0), ((F.get(shape, i) * size) for i in range(3))
    c = c * (1 + k % 2)
    lattice = F.array(F.array(a, zero, zero), F.array(b * z, b * sine, zero), F.array(c * y, c * top, c * F.sqrt(1 - y * y - top * top)))
    cells = t(spark, sf, "customer").select(k.alias("structure"), lattice.alias("lattice"))
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.col("structure") % 2)).alias("atom")
    atoms = cells.select("structure", place).select("structure", "atom", F.array(zero, zero, F.col("atom") / 2).alias("frac"), F.lit("Fe").alias("species"))
    return symmetry.symmetries(cells, atoms)


@query(
    f"""WITH {CELLS_SQL}, e(el, mass, radius) AS (VALUES ('F', 19.0, 0.5), ('O', 16.0, 0.6), ('P', NULL, 1.0)),
s AS (SELECT o_custkey s, count(*) n, CASE WHEN count(mass) = count(*) THEN sum(mass) END m, sum(radius ** 3) * 4 / 3 * pi() b FROM orders LEFT JOIN e ON el = o_orderstatus GROUP BY 1)
SELECT s AS "structure", round(m * 1.6605390666::DOUBLE / (ax * BY_ * cz), 9) density, round(ax * BY_ * cz / n, 9) volume_per_atom, round(b / (ax * BY_ * cz), 9) packing FROM s JOIN c USING (s)"""
)
def cell_densities(spark, sf):
    """Orders as atoms whose element is their status; one of those has no mass."""
    table = spark.createDataFrame([("F", 19.0, 0.5), ("O", 16.0, 0.6), ("P", None, 1.0)], "element string, mass double, radius double")
    atoms = t(spark, sf, "orders").select(F.col("o_custkey").alias("structure"), F.col("o_orderstatus").alias("species"))
    return rounded(symmetry.densities(_cells(spark, sf), atoms, table))


@query()
def graph_scores(spark, sf):
    """Each cell's neighbour graph through gated layers: an epoch over all graphs, chosen on a third of them."""
    cells, atoms = _cells(spark, sf), _atoms(spark, sf)
    edges = structures.periodic_neighbours(cells, atoms, 2.5, 4).select(F.col("structure").alias("graph"), F.col("other").cast("int").alias("src"), F.col("atom").cast("int").alias("dst"), "distance")
    edges = Held(spark).written(edges)
    nodes = atoms.select(F.col("structure").alias("graph"), F.col("atom").alias("node"), F.array((F.col("order") % 7) / 7.0, (F.col("order") % 3) / 3.0).cast("array<double>").alias("x"))
    labels = t(spark, sf, "customer").select(F.col("c_custkey").alias("graph"), (F.col("c_acctbal") > 4500).cast("int").alias("y"))
    third = F.pmod(F.xxhash64("graph"), F.lit(3)) == 0
    shape = graph_networks.Shape(width=4, bins=8, layers=1, dense=8, dense_layers=1)
    settings = networks.Settings(epochs=1, batch_size=labels.count() + 1, learning_rate=0.01)
    network, _ = graph_networks.fit_graph_network(nodes, edges, labels.filter(~third), labels.filter(third), shape, settings)
    return network.scored(nodes, edges, labels.select("graph")).select("graph", F.round("score", 6).alias("score"))
