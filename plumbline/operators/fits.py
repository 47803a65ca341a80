"""Fits whose sums are distributed and whose solutions are a few numbers on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import linear_score, sigmoid

FLOOR = 1e-12


@dataclass(frozen=True)
class Standardizer:
    """Means and population deviations of features; a deviation of at most the floor counts as 1."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    def apply(self) -> Column:
        """The standardized features as one array."""
        return F.array(*((F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(self.columns, self.means, self.deviations)))


def standardizer(rows: DataFrame, columns: Sequence[str], floor: float = FLOOR) -> Standardizer:
    found = rows.agg(*(F.avg(c) for c in columns), *(F.stddev_pop(c) for c in columns)).first()
    k = len(columns)
    if k and found[0] is None:
        raise ValueError("there are no rows to standardize by")
    return Standardizer(tuple(columns), tuple(found[:k]), tuple(s if s > floor else 1.0 for s in found[k:]))


def moments_of_arrays(rows: DataFrame, by: Sequence[str], values: str, floor: float = FLOOR) -> DataFrame:
    """(by, at, n, mean, deviation) for each place of an array column; a deviation of at most the floor counts as 1."""
    at = rows.select(*by, F.posexplode(values).alias("at", "v"))
    v = F.col("v").cast("double")
    return at.groupBy(*by, "at").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.when(F.stddev_pop(v) > floor, F.stddev_pop(v)).otherwise(1.0).alias("deviation"))


def _partial_gram(width: int):
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            if len(batch):
                x = np.column_stack([np.stack(batch["x"].to_numpy()).astype(np.float64), batch["y"].to_numpy(np.float64)])
                total += x.T @ x
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    return partial


def gram(rows: DataFrame, features: Column, target: Column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y: each task multiplies the rows that it reads, Spark adds (width + 1)^2 numbers of each task."""
    both = rows.select(features.alias("x"), target.cast("double").alias("y")).filter("y is not null")
    parts = both.mapInPandas(_partial_gram(width), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    full = np.zeros((width + 1, width + 1))
    for r in parts:
        full[r["i"], r["j"]] = r["v"]
    return full[:width, :width], full[:width, width]


def gram_cells(rows: DataFrame, values: str, width: int) -> DataFrame:
    """(i, j, v), i <= j, of X'X over the first places of an array column: sums of each task's own products.

    Rows whose array is null or shorter don't count."""
    x = F.slice(F.col(values).cast("array<double>"), 1, width)
    some = rows.select(x.alias("x"), F.lit(0.0).alias("y")).filter(F.size("x") == width)
    parts = some.mapInPandas(_partial_gram(width), "i int, j int, v double").filter((F.col("i") <= F.col("j")) & (F.col("j") < width))
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


@dataclass(frozen=True)
class LinearModel:
    standard: Standardizer
    weights: tuple[float, ...]
    bias: float

    def score(self) -> Column:
        return linear_score(self.weights, self.standard.apply(), self.bias)

    def probability(self) -> Column:
        return sigmoid(self.score())


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a x = b; an error where the smallest pivot says that there is none."""
    if np.linalg.matrix_rank(a, tol=1e-12) < len(a):
        raise ValueError("the normal equations are singular")
    return np.linalg.solve(a, b)


def ridge(rows: DataFrame, columns: Sequence[str], target: str, l2: float = 0.0) -> LinearModel:
    """Least squares on standardized features plus l2 |w|^2; the intercept is the mean and has no penalty."""
    standard = standardizer(rows, columns)
    mean = rows.agg(F.avg(target)).first()[0]
    xx, xy = gram(rows, standard.apply(), F.col(target) - F.lit(mean), len(columns))
    weights = solve(xx + l2 * np.eye(len(columns)), xy)
    return LinearModel(standard, tuple(map(float, weights)), float(mean))


def logistic_gradient(rows: DataFrame, features: Column, width: int, target: Column, weights: Sequence[float], bias: float) -> DataFrame:
    """One row: n, the mean error and the mean of error times each feature."""
    scored = rows.select(features.alias("x"), target.cast("double").alias("y"))
    error = sigmoid(linear_score(weights, F.col("x"), bias)) - F.col("y")
    return scored.withColumn("e", error).agg(
        F.count("e").alias("n"), F.avg("e").alias("g_bias"), *(F.avg(F.col("e") * F.get("x", i)).alias(f"g_{i}") for i in range(width))
    )


def logistic(rows: DataFrame, columns: Sequence[str], target: Column, steps: int = 500, rate: float = 0.1, l2: float = 0.0) -> LinearModel:
    """A fixed number of full gradient steps from zero; the penalty is on weights only.

    Each step is one aggregation over cached standardized rows; nothing but the gradient leaves them."""
    standard = standardizer(rows, columns)
    x = rows.select(standard.apply().alias("x"), target.cast("double").alias("y")).persist()
    weights, bias = np.zeros(len(columns)), 0.0
    try:
        for _ in range(steps):
            g = logistic_gradient(x, F.col("x"), len(columns), F.col("y"), weights.tolist(), bias).first()
            bias -= rate * g["g_bias"]
            weights = weights - rate * (np.array([g[f"g_{i}"] for i in range(len(columns))]) + l2 * weights / max(1, g["n"]))
    finally:
        x.unpersist()
    return LinearModel(standard, tuple(map(float, weights)), float(bias))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * n), which balances the classes."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    sizes = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return counts.crossJoin(F.broadcast(sizes)).select("label", "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def grown_depth(n: int, leaf: int, room: int) -> int:
    """The depth of trees that part n rows into leaves: the logarithm of their number and `room`, 30 (Spark's) at most."""
    return min(30, max(1, int(np.ceil(np.log2(max(2, n / leaf)))) + room))


def balanced_forest(rows: DataFrame, features: str, label: str, trees: int = 50, seed: int = 0, leaf: int = 1, depth: int | None = None):
    """A random forest on an array column, rows weighted so that classes count alike.

    Leaves hold `leaf` rows at least. Unless a depth is given trees grow out: twice the logarithm of the rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    weighted = rows.join(F.broadcast(class_weights(rows, label)), F.col(label) == F.col("label"), "inner") if label != "label" else rows.join(class_weights(rows, label), "label")
    ready = weighted.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("y"), "weight")
    if depth is None:
        n = max(2, rows.count() // leaf)
        depth = grown_depth(n, 1, int(np.ceil(np.log2(n))))
    forest = RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="weight", numTrees=trees, seed=seed, maxDepth=depth, minInstancesPerNode=leaf)
    return forest.fit(ready)


#: Rows of a leaf that a tree aims at.
LEAF = 20


@dataclass(frozen=True)
class QuantileForest:
    """A fitted forest and, for each leaf of each tree, the training targets in it with their shares."""

    model: object
    held: DataFrame
    features: str
    trees: int

    def spread(self, rows: DataFrame, key: str, levels: Sequence[float]) -> DataFrame:
        """(key, values): quantiles of the targets that share leaves with a row, an entry for each level, trees counting alike.

        In each tree, training rows of the row's leaf have weight 1 / leaf size; their mean over trees is
        the target's weight, and a quantile is the first target whose running weight reaches the level.
        Rows whose leaves are the same in every tree have the same quantiles: each distinct vector of leaves
        meets the targets of its leaves once, one array for each tree, and is joined back to its rows."""
        at = _leaf_vectors(self.model, rows, self.features, F.col(key).alias(key))
        leaf = F.posexplode("leaves").alias("tree", "leaf")
        met = at.select("leaves").distinct().select("leaves", leaf).join(self.held, ["tree", "leaf"])
        met = met.groupBy("leaves").agg(F.flatten(F.collect_list("targets")).alias("t"))
        trees = self.trees

        def of(y: pd.Series, share: pd.Series) -> pd.Series:
            out = []
            for values, weights in zip(y, share):
                order = np.argsort(values, kind="stable")
                run, values = np.cumsum(weights[order]) / trees, values[order]
                out.append([float(values[min(np.searchsorted(run, q - 1e-9), len(values) - 1)]) for q in levels])
            return pd.Series(out)

        of.__annotations__ = {"y": pd.Series, "share": pd.Series, "return": pd.Series}
        parts = (F.transform("t", lambda x: x[n]) for n in ("y", "share"))
        found = met.select("leaves", F.pandas_udf(of, "array<double>")(*parts).alias("values"))
        return at.join(found, "leaves").select(key, "values")

    def quantiles(self, rows: DataFrame, key: str, levels: Sequence[float]) -> DataFrame:
        """(key, level, value), as `spread`."""
        both = F.arrays_zip(F.array(*(F.lit(float(q)) for q in levels)).alias("level"), F.col("values").alias("value"))
        return self.spread(rows, key, levels).select(key, F.explode(both).alias("r")).select(key, "r.*")


def _leaf_vectors(model, rows: DataFrame, features: str, *keep: Column) -> DataFrame:
    """What is kept, and the number of a row's leaf in each tree."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    kept = [f"_k{i}" for i in range(len(keep))]
    vector = array_to_vector(F.col(features).cast("array<double>")).alias("features")
    scored = model.transform(rows.select(vector, *(c.alias(k) for c, k in zip(keep, kept))))
    out = scored.select(*kept, vector_to_array("leaves").cast("array<int>").alias("leaves"))
    return out.withColumnsRenamed(dict(zip(kept, rows.select(*keep).columns)))


def _leaves(model, rows: DataFrame, features: str, *keep: Column) -> DataFrame:
    found = _leaf_vectors(model, rows, features, *keep)
    return found.select(*(c for c in found.columns if c != "leaves"), F.posexplode("leaves").alias("tree", "leaf"))


def fit_quantile_forest(train: DataFrame, features: str, target: str, trees: int = 20, leaf: int = LEAF, seed: int = 0) -> QuantileForest:
    """A forest whose trees grow with the table, so that leaves don't: depth is the logarithm of rows over `leaf`, and 2.

    So what a row meets, trees times a leaf, doesn't grow with the table, and predicting is in proportion
    to it. Leaves that features can't part further, or that are at Spark's depth of 30, are longer; equal
    targets in a leaf are one entry of its array."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    y = F.col(target).cast("double").alias("y")
    rows = train.select(F.col(features).cast("array<double>").alias("x"), y).filter("y is not null").persist()
    try:
        n = rows.count()
        if not n:
            raise ValueError("there are no rows to grow a forest on")
        depth = grown_depth(n, leaf, 2)
        forest = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=trees, seed=seed, leafCol="leaves", maxDepth=depth, minInstancesPerNode=min(leaf, max(1, n // 2)))
        model = forest.fit(rows.select(array_to_vector("x").alias("features"), "y"))
    finally:
        rows.unpersist()
    counts = _leaves(model, train.filter(F.col(target).isNotNull()), features, y).groupBy("tree", "leaf", "y").agg(F.count("*").alias("n"))
    # sorted, so that weights are added in one order always
    held = counts.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("y", "n"))).alias("t"), F.sum("n").alias("size"))
    held = held.select("tree", "leaf", F.transform("t", lambda x: F.struct(x["y"].alias("y"), (x["n"] / F.col("size")).alias("share"))).alias("targets"))
    return QuantileForest(model, held, features, trees)


def quantile_forest(train: DataFrame, queries: DataFrame, key: str, features: str, target: str, levels: Sequence[float], trees: int = 20, seed: int = 0) -> DataFrame:
    """(key, level, value) of the rows of `queries` by a forest grown on `train`."""
    return fit_quantile_forest(train, features, target, trees, seed=seed).quantiles(queries, key, levels)
