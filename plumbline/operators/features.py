"""Feature arrays: pooling over parts, sums over graph edges, ladders of meshes, blocks side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def pooled(rows: DataFrame, by: Sequence[str], values: str) -> DataFrame:
    """(by, features): mean, largest and population deviation of each place of an array, one after the other.

    Places are summed apart with partial sums; a group's arrays never meet in one task."""
    at = rows.select(*by, F.posexplode(values).alias("at", "v")).withColumn("v", F.col("v").cast("double"))
    stats = at.groupBy(*by, "at").agg(F.avg("v").alias("mean"), F.max("v").alias("top"), F.stddev_pop("v").alias("dev"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "mean", "top", "dev")))

    def part(name: str) -> Column:
        return F.transform("o", lambda s: s[name])

    parts = [part(n) for n in ("mean", "top", "dev")]
    return stats.groupBy(*by).agg(ordered.alias("o")).select(*by, F.concat(*parts).alias("features"))


def blocks(rows: DataFrame, columns: Sequence[str], width: int) -> DataFrame:
    """`rows` with `features`: blocks side by side. Another width, or a number that isn't finite, is an error."""
    joined = F.concat(*(F.col(c).cast("array<double>") for c in columns))
    finite = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (F.size("features") == width) & finite
    out = rows.withColumn("features", joined)
    return out.withColumn("features", F.when(good, F.col("features")).otherwise(F.raise_error(F.lit(f"features must be {width} finite numbers"))))


def edge_sums(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """(dst, n_edges, total): the values of the sources of each node's incoming edges, added up."""
    message = edges.join(nodes.select(F.col("node").alias("src"), value), "src")
    return message.groupBy("dst").agg(F.count("*").alias("n_edges"), F.sum(value).alias("total"))


def graph_means(nodes: DataFrame, graph: str, value: str) -> DataFrame:
    return nodes.groupBy(graph).agg(F.count("*").alias("n_nodes"), F.avg(value).alias("mean"))


def ladder(rows: DataFrame, key: str, length: Column, rungs: int) -> DataFrame:
    """(key, rung, mesh, change, probe): the meshes of a vector as spacing shrinks.

    With n points the spacing is at least length / n: rung n - 1 starts there, and the probe of a rung is
    the middle between its start and the one before."""
    n = F.explode(F.sequence(F.lit(1), F.lit(rungs))).alias("mesh")
    at = rows.select(F.col(key), length.cast("double").alias("length"), n)
    w = Window.partitionBy(key).orderBy("mesh")
    change = F.col("length") / F.col("mesh")
    out = at.withColumn("change", change).withColumn("probe", (F.col("change") + F.lead("change").over(w)) / 2)
    return out.select(key, (F.col("mesh") - 1).alias("rung"), "mesh", "change", "probe")


def lattice_block(rows: DataFrame, key: str, a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> DataFrame:
    """(key, a, b, c, alpha, beta, gamma, volume, ra, rb, rc, low, middle, high) of cells given by three vectors.

    Lengths and angles, volume, lengths of the reciprocal vectors and the eigenvalues of their metric. Each
    step is a projection of its own, so that no expression repeats another's."""
    axes = {n: v for n, v in zip("abc", (a, b, c))}
    out = rows.select(F.col(key), *(x.cast("double").alias(f"_{n}{i}") for n, v in axes.items() for i, x in enumerate(v)))
    vector = {n: [F.col(f"_{n}{i}") for i in range(3)] for n in "abc"}
    out = out.withColumns(S.lattice(vector["a"], vector["b"], vector["c"]))
    turned = S.reciprocal(vector["a"], vector["b"], vector["c"])
    out = out.withColumns({f"_r{i}{j}": x for i, v in enumerate(turned) for j, x in enumerate(v)})
    r = [[F.col(f"_r{i}{j}") for j in range(3)] for i in range(3)]
    out = out.withColumns({f"_m{i}{j}": r[i][0] * r[j][0] + r[i][1] * r[j][1] + r[i][2] * r[j][2] for i in range(3) for j in range(i, 3)})
    out = out.withColumns({n: F.sqrt(f"_m{i}{i}") for i, n in enumerate(("ra", "rb", "rc"))})
    m = [[F.col(f"_m{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    out = out.withColumn("_e", S.symmetric_eigenvalues(m)).withColumns({n: F.get("_e", i) for i, n in enumerate(("low", "middle", "high"))})
    return out.select(key, "a", "b", "c", "alpha", "beta", "gamma", "volume", "ra", "rb", "rc", "low", "middle", "high")


# The columns of the reciprocal block, in order.
RECIPROCAL = (
    "ra", "rb", "rc", "rvolume", "ralpha", "rbeta", "rgamma", "trace", "trace_squared", "determinant", "spread", "longest_ratio", "middle_ratio", "skew",
)


def reciprocal_block(rows: DataFrame, key: str, a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> DataFrame:
    """(key, 14 columns) of the reciprocal cell, with the factor 2 pi.

    Lengths, volume and angles; trace, trace of the square, determinant and ratio of the outer eigenvalues
    of M'M, whose rows are the reciprocal vectors; the longest and the middle length over the shortest; and
    the sum of the angles' absolute cosines."""
    out = rows.select(F.col(key), *(x.cast("double").alias(f"_{n}{i}") for n, v in zip("abc", (a, b, c)) for i, x in enumerate(v)))
    turned = S.reciprocal(*([F.col(f"_{n}{i}") for i in range(3)] for n in "abc"))
    out = out.withColumns({f"_r{i}{j}": x for i, v in enumerate(turned) for j, x in enumerate(v)})
    r = [[F.col(f"_r{i}{j}") for j in range(3)] for i in range(3)]
    shape = S.lattice(*r)
    out = out.withColumns({f"r{n}": x for n, x in shape.items()})
    out = out.withColumns({f"_m{i}{j}": r[0][i] * r[0][j] + r[1][i] * r[1][j] + r[2][i] * r[2][j] for i in range(3) for j in range(i, 3)})
    m = [[F.col(f"_m{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    out = out.withColumn("_e", S.symmetric_eigenvalues(m)).withColumn("_l", F.array_sort(F.array("ra", "rb", "rc")))
    cosines = [F.abs(F.cos(F.radians(n))) for n in ("ralpha", "rbeta", "rgamma")]
    minors = [m[1][1] * m[2][2] - m[1][2] * m[1][2], m[0][1] * m[2][2] - m[1][2] * m[0][2], m[0][1] * m[1][2] - m[1][1] * m[0][2]]
    more = {
        "trace": m[0][0] + m[1][1] + m[2][2], "trace_squared": sum((x * x for row in m for x in row[1:]), m[0][0] * m[0][0] + m[1][0] * m[1][0] + m[2][0] * m[2][0]),
        "determinant": m[0][0] * minors[0] - m[0][1] * minors[1] + m[0][2] * minors[2], "spread": F.get("_e", 2) / F.get("_e", 0),
        "longest_ratio": F.get("_l", 2) / F.get("_l", 0), "middle_ratio": F.get("_l", 1) / F.get("_l", 0), "skew": cosines[0] + cosines[1] + cosines[2],
    }
    return out.withColumns(more).select(key, *RECIPROCAL)


def until_jump(meshes: DataFrame, key: str, order: str, axes: Sequence[str]) -> DataFrame:
    """The rows of each key before the first at which an axis grows by more than one."""
    w = Window.partitionBy(key).orderBy(order)
    jump = F.lit(False)
    for a in axes:
        jump = jump | F.coalesce(F.col(a) - F.lag(a).over(w) > 1, F.lit(False))
    out = meshes.withColumn("_jump", jump.cast("int"))
    return out.withColumn("_seen", F.max("_jump").over(w)).filter("_seen = 0").drop("_jump", "_seen")


def composition_stats(rows: DataFrame, key: str, parts: DataFrame, properties: DataFrame, names: Sequence[str]) -> DataFrame:
    """(key, <name>_mean, _min, _max, _range): properties of a composition's elements, means weighted by amount.

    `parts` is (key, element, amount) and `properties` (element, <names>): element data is a lookup table.
    Every row of `rows` stays. Where it has no parts, or an element or its property isn't known, nothing can
    be said of the whole, and that property's numbers are null."""
    known = properties.groupBy("element").agg(*(F.min(n).cast("double").alias(n) for n in names))
    joined = rows.select(key).distinct().join(parts.select(key, "element", "amount"), key, "left").join(known, "element", "left")
    aggs = []
    for n in names:
        whole = F.count(n) == F.count("*")
        found = {"mean": F.sum(F.col(n) * F.col("amount")) / F.sum("amount"), "min": F.min(n), "max": F.max(n), "range": F.max(n) - F.min(n)}
        aggs += [F.when(whole, v).alias(f"{n}_{k}") for k, v in found.items()]
    return joined.groupBy(key).agg(*aggs)


def _held(rows: DataFrame, key: str, parts: DataFrame, table: DataFrame, names: Sequence[str]) -> DataFrame:
    """(key, total, gaps, held): each composition's elements once, with their share of all amounts and their properties.

    A composition has no more elements than there are, so its array is bounded. `gaps` counts elements that aren't known."""
    known = table.groupBy("element").agg(*(F.min(n).cast("double").alias(n) for n in names))
    some = parts.groupBy(key, "element").agg(F.sum(F.col("amount").cast("double")).alias("amount"), F.count_if(F.col("amount").isNull()).alias("_null"))
    joined = some.join(known.withColumn("_known", F.lit(True)), "element", "left")
    bad = F.col("_known").isNull() | (F.col("_null") > 0) | ~(F.col("amount") > 0)
    held = joined.groupBy(key).agg(F.sum("amount").alias("total"), F.count_if(F.coalesce(bad, F.lit(True))).alias("gaps"), F.array_sort(F.collect_list(F.struct("element", "amount", *names))).alias("held"))
    return rows.select(key).distinct().join(held, key, "left")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


#: The statistics of a property, and the orders of the norms of a composition.
STATISTICS, NORMS, SHELLS = ("minimum", "maximum", "range", "mean", "avg_dev", "mode"), (0, 2, 3, 5, 7, 10), ("s", "p", "d", "f")


def composition_block(rows: DataFrame, key: str, parts: DataFrame, table: DataFrame, names: Sequence[str], shells: Sequence[str] = SHELLS) -> DataFrame:
    """(key, norms, properties, shells) of compositions: what they are made of, in numbers.

    `norm_<p>` are the norms of the elements' shares, that of order 0 their number. For each property
    <name>_minimum, _maximum, _range, _mean, _avg_dev and _mode: means are weighted by share, `avg_dev` is the mean distance from the
    mean, `mode` the value of the largest share, the smallest value of equal shares. For each shell, a column of `table` that
    counts its electrons: the mean number <shell>_avg and its share of all shells' <shell>_frac, 0 where there are none.
    `parts` is (key, element, amount) and `table` (element, names, shells); amounts of one element are added up. Every row of `rows` stays, with nulls where
    it has no parts, an amount isn't above 0 or an element isn't known; a property that one of its elements lacks is null as well."""
    held = _held(rows, key, parts, table, [*names, *shells])
    share = F.transform("held", lambda e: e["amount"] / F.col("total"))
    out = held.withColumn("_w", F.when(F.col("gaps") == 0, share))

    def norm(p: int) -> Column:
        found = F.pow(_total(F.transform("_w", lambda w: F.pow(w, F.lit(float(p))))), F.lit(1.0 / p)) if p else F.size("_w").cast("double")
        return F.when(F.col("_w").isNotNull(), found).alias(f"norm_{p}")

    def held_value(name: str) -> Column:
        return F.transform("held", lambda e: e[name])

    def distance(values: Column, mean: Column) -> Column:
        return _total(F.zip_with(values, "_w", lambda x, w: F.abs(x - mean) * w))

    norms, values = map(norm, NORMS), {n: held_value(n) for n in (*names, *shells)}
    whole = {n: F.when(F.col("_w").isNotNull() & F.forall(v, lambda x: x.isNotNull()), v) for n, v in values.items()}
    out = out.select(key, "_w", *norms, *(whole[n].alias(f"_v_{n}") for n in values))
    mean = {n: _total(F.zip_with(f"_v_{n}", "_w", lambda x, w: x * w)) for n in values}
    out = out.withColumns({f"_m_{n}": m for n, m in mean.items()})
    largest = F.array_max("_w")
    # shares that agree to twelve digits are equal
    top = lambda n: F.filter(F.zip_with(f"_v_{n}", "_w", lambda x, w: F.when(w >= largest - 1e-12, x)), lambda x: x.isNotNull())
    said = []
    for n in names:
        v, m = F.col(f"_v_{n}"), F.col(f"_m_{n}")
        found = (F.array_min(v), F.array_max(v), F.array_max(v) - F.array_min(v), m, distance(v, m), F.array_min(top(n)))
        said += [F.when(v.isNotNull(), x).alias(f"{n}_{k}") for k, x in zip(STATISTICS, found)]
    all_ = sum((F.col(f"_m_{n}") for n in shells[1:]), F.col(f"_m_{shells[0]}")) if shells else None
    said += [F.col(f"_m_{n}").alias(f"{n}_avg") for n in shells] + [F.when(all_ > 0, F.col(f"_m_{n}") / all_).when(all_.isNotNull(), 0.0).alias(f"{n}_frac") for n in shells]
    return out.select(key, *(f"norm_{p}" for p in NORMS), *said)


def common_divisor(amounts: Column) -> Column:
    """The greatest common divisor of an array of longs, by Euclid; 93 steps are enough for any two of them."""

    def both(g: Column, x: Column) -> Column:
        start = F.struct(g.alias("a"), x.alias("b"))
        ended = F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))))
        return ended["a"]

    return F.aggregate(amounts, F.lit(0).cast("long"), both)


def reduced_formula(parts: DataFrame, key: str) -> DataFrame:
    """(key, formula): elements in order with their amounts, whole ones divided by their greatest common divisor.

    Amounts of one element are added up. If an amount isn't whole they are written as they are, to six
    digits. An amount of 1 isn't written. The formula is null where an amount is null or not above 0."""
    some = parts.groupBy(key, "element").agg(F.sum("amount").cast("double").alias("amount"), F.count_if(F.col("amount").isNull()).alias("gaps"))
    held = some.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("element", "amount"))).alias("o"), F.min("amount").alias("least"), F.sum("gaps").alias("gaps"))
    whole = F.forall("o", lambda e: e["amount"] == F.floor(e["amount"]))
    held = held.withColumn("d", F.when(whole, common_divisor(F.transform("o", lambda e: e["amount"].cast("long")))))

    def written(e: Column) -> Column:
        n = e["amount"].cast("long") / F.col("d")
        said = F.when(F.col("d").isNotNull(), n.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", e["amount"]), r"\.?0+$", ""))
        return F.concat(e["element"], F.when(said == "1", "").otherwise(said))

    good = (F.col("gaps") == 0) & (F.col("least") > 0)
    return held.select(key, F.when(good, F.concat_ws("", F.transform("o", written))).alias("formula"))


# Electrons that a d and an f shell hold, and the share of a limit that a moment starts within.
CAPACITY = {"d": 10, "f": 14}
WITHIN_LIMIT = 0.7


def open_shell(orbitals: Column, oxidation: Column) -> Column:
    """(shell, capacity, electrons) from which an ion's moment comes; null without one.

    `orbitals` are (n, shell, electrons) of the neutral atom in order. It is the last f shell that is partly
    filled, else the last d shell. Electrons of higher n leave first, then those of the shell; an anion's
    come to the shell. No oxidation counts as 0."""
    partly = F.filter(orbitals, lambda o: (o["shell"] == "f") & (o["electrons"] > 0) & (o["electrons"] < CAPACITY["f"]))
    some = F.when(F.size(partly) > 0, partly).otherwise(F.filter(orbitals, lambda o: o["shell"] == "d"))
    last = F.when(F.size(some) > 0, F.element_at(some, -1))

    def of(o: Column) -> Column:
        outer = F.aggregate(orbitals, F.lit(0.0), lambda s, x: s + F.when(x["n"] > o["n"], x["electrons"].cast("double")).otherwise(0.0))
        charge = F.coalesce(oxidation.cast("double"), F.lit(0.0))
        left = o["electrons"].cast("double") - F.when(charge >= 0, F.greatest(charge - outer, F.lit(0.0))).otherwise(charge)
        room = F.when(o["shell"] == "f", float(CAPACITY["f"])).otherwise(float(CAPACITY["d"]))
        return F.struct(o["shell"].alias("shell"), room.alias("capacity"), F.least(F.greatest(left, F.lit(0.0)), room).alias("electrons"))

    return F.get(F.transform(F.when(last.isNotNull(), F.array(last)), of), 0)


def seed_moment(orbitals: Column, oxidation: Column, limit: Column) -> Column:
    """High-spin moment of an ion's open shell, kept to 0.7 of its element's limit; 0 without a shell or a limit."""
    shell = open_shell(orbitals, oxidation)
    spins = F.least(shell["electrons"], shell["capacity"] - shell["electrons"])
    return F.when(shell.isNotNull() & limit.isNotNull(), F.least(spins, WITHIN_LIMIT * limit)).otherwise(0.0)
