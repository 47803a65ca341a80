"""Embedding near-duplicates: an exact cosine join by the pigeonhole over rotated low-dimensional blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Labels, components, table, written

COSINE = 0.93
BLOCKS = 4
SEED = 4
#: Vectors of one cell that a task compares with as many others; larger cells are compared part by part.
PART = 8192
#: Relative room for rounding: a budget is exceeded only beyond it, so no pair is lost.
ROOM = 1e-4
STRIP = 512
PAIRS = 1 << 15


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dimensions]).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def block_edges(dimensions: int, blocks: int = BLOCKS) -> list[int]:
    blocks = min(blocks, dimensions)
    return [round(dimensions * i / blocks) for i in range(blocks + 1)]


def budgets(dimensions: int, cosine: float = COSINE, blocks: int = BLOCKS) -> np.ndarray:
    """The squared distance that each block may have: together that of unit vectors at the least cosine."""
    return 2 * (1 - cosine) * np.diff(block_edges(dimensions, blocks)) / dimensions


PREPARED = "turned binary, blocks array<struct<own:array<int>,coords:binary>>"


def packed(vectors: pd.Series) -> pd.Series:
    """The numbers of each vector as they come; null unless they are finite and one at least isn't zero."""
    return pd.Series([v.tobytes() if v is not None and len(v) and np.isfinite(v).all() and v.any() else None for v in vectors], dtype=object)


def unit(vector: np.ndarray) -> np.ndarray:
    """The vector in double precision at length 1, scaled first so that no square overflows or vanishes."""
    v = vector.astype(np.float64)
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def _prepare(cosine: float, grid: int, kind: str):
    def prepare(vectors: pd.Series) -> pd.DataFrame:
        rows = []
        for v in vectors:
            turned = unit(np.frombuffer(v, kind))
            turned = (turned @ rotation_of(len(turned))).astype("<f4")
            edges, width = block_edges(len(turned)), np.sqrt(budgets(len(turned), cosine)) * (1 + 10 * ROOM)
            blocks = [
                {"own": np.floor(turned[a : min(b, a + grid)].astype(np.float64) / w).astype(np.int32).tolist(), "coords": turned[a:b].tobytes()}
                for a, b, w in zip(edges, edges[1:], width)
            ]
            rows.append((turned.tobytes(), blocks))
        return pd.DataFrame(rows, columns=["turned", "blocks"])

    prepare.__annotations__ = {"vectors": pd.Series, "return": pd.DataFrame}
    return prepare


_ROTATIONS: dict[int, np.ndarray] = {}


def rotation_of(dimensions: int) -> np.ndarray:
    if dimensions not in _ROTATIONS:
        _ROTATIONS[dimensions] = rotation(dimensions)
    return _ROTATIONS[dimensions]


def _candidates(a: np.ndarray, b: np.ndarray, same: bool, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) whose rows of a and b are within `budget` or little more; i < j if both are the same rows."""
    b_sq = (b * b).sum(axis=1)
    for at in range(0, len(a), STRIP):
        some = a[at : at + STRIP]
        near = (some * some).sum(axis=1)[:, None] + b_sq - 2 * some @ b.T <= budget * (1 + 2 * ROOM) + 1e-12
        i, j = np.nonzero(near)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), PAIRS):
            yield i[k : k + PAIRS], j[k : k + PAIRS]


KEY = ["label", "length", "block", "cell", "part_a", "part_b"]


def _meetings(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Places of rows that a task compares with each other, and whether both are the same: those at home in the
    cell with those of the other part that are at home or come from the cell before."""
    part_a, part_b = int(rows["part_a"].iloc[0]), int(rows["part_b"].iloc[0])
    home, part = rows["home"].to_numpy(), rows["part"].to_numpy()
    at = {(h, p): np.flatnonzero((home == h) & (part == p)) for h in (True, False) for p in {part_a, part_b}}
    yield at[True, part_a], at[True, part_b], part_a == part_b
    yield at[True, part_a], at[False, part_b], False
    if part_a != part_b:
        yield at[True, part_b], at[False, part_a], False


def _near(coords: np.ndarray, rows: pd.DataFrame, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that a task compares and that are within a block's budget, or little more."""
    for a, b, same in _meetings(rows):
        if len(a) and len(b):
            for i, j in _candidates(coords[a], coords[b], same, budget):
                yield a[i], b[j]


def _array(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _gather(cosine: float):
    """Of the rows of a task those that are within the block's budget of another."""

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        budget = float(budgets(int(rows["length"].iloc[0]), cosine)[int(rows["block"].iloc[0])])
        hit = np.zeros(len(rows), bool)
        for i, j in _near(_array(rows["coords"], "<f4").astype(np.float64), rows, budget):
            hit[i] = hit[j] = True
        return rows.loc[hit, [*KEY, "home", "part", "cid"]]

    return gather


def _verify(cosine: float, kind: str):
    """Counts of links, and a forest of them, for pairs that keep the budget of this block and of none before."""

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["block"].iloc[0])
        turned = _array(rows["turned"], "<f4").astype(np.float64)
        units = np.array([unit(np.frombuffer(v, kind)) for v in rows["vector"]])
        copies = rows["copies"].to_numpy()
        edges, allowed = block_edges(turned.shape[1]), budgets(turned.shape[1], cosine) * (1 + ROOM)
        own = slice(edges[block], edges[block + 1])
        links, labels = np.zeros(len(rows), np.int64), Labels(len(rows))
        for i, j in _near(turned[:, own], rows, float(allowed[block])):
            found = np.einsum("ij,ij->i", units[i], units[j]) >= cosine
            i, j = i[found], j[found]
            gaps = np.add.reduceat((turned[i] - turned[j]) ** 2, edges[:-1], axis=1) <= allowed
            first = gaps[:, block] & ~gaps[:, :block].any(axis=1)
            i, j = i[first], j[first]
            links += np.bincount(i, copies[j], len(rows)).astype(np.int64) + np.bincount(j, copies[i], len(rows)).astype(np.int64)
            labels.join(i, j)
        told = np.flatnonzero(links)
        out = pd.DataFrame({"cid": rows["cid"].to_numpy()[told], "n": links[told]})
        a, b = labels.stars()
        reps = rows["rep"].to_numpy()
        stars = pd.DataFrame({"a": reps[a], "b": reps[b]})
        return pd.concat([out.astype("Int64"), stars.astype("Int64")], ignore_index=True).reindex(columns=["cid", "n", "a", "b"])

    return verify


def choose_grid(n: int) -> int:
    """Coordinates of a block that make a cell: none while a label is one part, then one, then one more for each
    time that it outgrows some 100 parts."""
    grid = int(n > PART)
    while n > 100 * PART and grid < 4:
        n, grid = n // 6, grid + 1
    return grid


def half_steps(grid: int) -> list[list[int]]:
    """A cell's own place and every neighbour that comes after it: of two neighbours, one looks for the other."""
    return [list(s) for s in product((-1, 0, 1), repeat=grid) if s >= (0,) * grid]


def _dealt(classes: DataFrame, grid: int) -> DataFrame:
    """Each class to the cells of each of its blocks, and crowded cells in parts of which every two meet."""
    spread = classes.select("label", "length", "cid", F.posexplode("blocks").alias("block", "b")).select("label", "length", "cid", "block", "b.*")
    # a block of fewer coordinates than the grid has steps in those only
    steps = F.array(*(F.array(*map(F.lit, s)).cast("array<int>") for s in half_steps(grid)))
    steps = F.array_distinct(F.transform(F.filter(steps, lambda s: F.forall(F.slice(s, F.size("own") + 1, grid + 1), lambda x: x == 0)), lambda s: F.slice(s, 1, F.size("own"))))
    spread = spread.withColumn("step", F.explode(steps)).withColumn("home", F.forall("step", lambda x: x == 0))
    spread = spread.withColumn("cell", F.zip_with("own", "step", lambda a, b: a + b))
    key = KEY[:4]
    crowded = spread.groupBy(*key).count().filter(F.col("count") > PART)
    crowded = crowded.select(*key, F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    met = F.transform(
        F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least(F.col("part"), o).alias("part_a"), F.greatest(F.col("part"), o).alias("part_b"))
    )
    dealt = spread.join(crowded, key, "left").withColumn("part", F.pmod(F.xxhash64("cid"), parts).cast("int")).withColumn("m", F.explode(met))
    return dealt.select(*key, "m.part_a", "m.part_b", "home", "part", "cid", "coords")


def link_near(embeddings: DataFrame, cosine: float = COSINE, grid: int | None = None) -> DataFrame:
    """One row for each row of `embeddings` (vec_id, label, embedding): n_links, component_id and kept.

    Vectors of one label and length are linked if their cosine in double precision is `cosine` or more.
    Unit vectors at that cosine are at a squared distance of at most 2 - 2 cosine; rotated and split in
    blocks, they keep to their share of it in one block at least. For each block, a vector's coordinates
    in it go to the cell of the first of them, as wide as the block's budget allows, and to the cells
    after it. Who is within the budget of another there is gathered once more, with its whole vector, and
    compared by cosine. A pair is counted in the first block whose budget it keeps, so links need no list
    of pairs: tasks hand on counts and forests. How many coordinates make a cell changes no result; by
    default it follows the largest label.

    Equal vectors of a label form a class that is compared once and counts as often as it has rows.
    A vector that is null, empty, zero or has null or non-finite components, or has no label, links with
    nothing; a null vec_id neither, and its component is null. Rows of one vec_id are vectors of their own,
    each with its own count, which they add to each other's; as ids they are one and reach what any of them does."""
    spark = embeddings.sparkSession
    single = embeddings.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = "<f4" if single else "<f8"
    numbers = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    vector = F.pandas_udf(packed, "binary")(F.when(there, numbers))
    rows = written(embeddings.select("vec_id", "label", vector.alias("vector")).withColumn("digest", F.sha2("vector", 256)), "embedding-rows")
    classes = rows.filter("vector is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    if grid is None:
        grid = choose_grid(rows.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    length = (F.octet_length("vector") / np.dtype(kind).itemsize).cast("int").alias("length")
    # numbers of classes hold once they are written
    classes = classes.select("*", length, F.monotonically_increasing_id().alias("cid"), F.pandas_udf(_prepare(cosine, grid, kind), PREPARED)("vector").alias("p"))
    classes = written(classes.select("label", "digest", "rep", "copies", "vector", "length", "cid", "p.*"), "embedding-classes")
    shape = f"label {classes.schema['label'].dataType.simpleString()}, length int, block int, cell array<int>, part_a int, part_b int, home boolean, part int, cid long"
    near = _dealt(classes, grid).groupBy(*KEY).applyInPandas(_gather(cosine), shape)
    found = near.join(classes.select("cid", "rep", "copies", "vector", "turned"), "cid").groupBy(*KEY)
    found = written(found.applyInPandas(_verify(cosine, kind), "cid long, n long, a long, b long"), "embedding-links")
    links = found.filter("cid is not null").groupBy("cid").agg(F.sum("n").alias("links"))
    members = classes.select("label", "digest", "rep", "copies", "cid").join(links, "cid", "left")
    members = members.select(F.col("label").alias("l"), F.col("digest").alias("d"), "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    rows = rows.select("vec_id", "label", "digest").join(members, (F.col("label") == F.col("l")) & (F.col("digest") == F.col("d")), "left")
    rows = written(rows.select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), "n"), "embedding-members")
    # a vec_id in several classes joins them
    several = rows.groupBy("vec_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x <> y").select("vec_id")
    joins = rows.join(several, "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    reached = components(found.filter("a is not null").select("a", "b").unionByName(joins), "embedding-components")
    out = rows.join(reached, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near(table(spark, sf_dir, "embeddings"))
