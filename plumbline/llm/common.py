"""Shared folders, written intermediate tables and distributed connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it.

    Only where the setting is missing and the master is local (tests on one machine) is a temporary folder
    made and used for the rest of the application; on a cluster executors wouldn't see each other's files
    there, so that is an error."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.split("[")[0] == "local":
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="plumbline-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """Where this application's tables are, below the shared folder."""
    return f"{shared_dir(spark)}/plumbline/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{application_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def remove_written(spark: SparkSession) -> None:
    """Deletes the tables that this application has written, once no result of theirs is wanted any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` written to the shared folder and read again.

    This cuts the lineage: what follows reads files that survive any executor."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Inside, what is run hands tables to Python in batches of at most so many bytes."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


_REMEMBERING: list = []


def remembering(memory) -> None:
    """Lets a worker that goes over to another operator's words forget those of the one before, and give back what Arrow holds unused.

    `memory` has a method `forget`. What is remembered saves time only, so forgetting changes no result."""
    if not _REMEMBERING or _REMEMBERING[0] is not memory:
        for other in _REMEMBERING:
            other.forget()
        pa.default_memory_pool().release_unused()
        _REMEMBERING[:] = [memory]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact(*names: str) -> list[Column]:
    """Columns of longs as texts: on their way to pandas longs with nulls among them would become doubles."""
    return [F.col(n).cast("string").alias(n) for n in names]


def numbers(column: pd.Series) -> list[int | None]:
    """The longs that `exact` has made texts."""
    return [None if x is None else int(x) for x in column]


def longs(values: list[int | None]) -> pd.Series:
    return pd.Series(pd.array(values, "Int64"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo `parts`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def _halves(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """One star step: every vertex hands the smallest id that it sees to its larger, or its smaller, neighbours."""
    if keep_larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.join(least, "a")
    if keep_larger:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, component) for every end of `edges` (a, b: long): the smallest id that can be reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Edges stay distributed; each
    round is written to the shared folder, so that plans stay short and a lost executor costs one
    round at most. The driver sees a count and a hash sum per round."""
    current = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), tag
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = state(current)
    while seen[0]:
        current = written(_halves(_halves(current, True), False), tag)
        now = state(current)
        if now == seen:
            break
        seen = now
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Labels:
    """Components of n places, joined by arrays of pairs: a place's label is the smallest place that it reaches."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs whose ends are joined already cost a comparison only."""
        while True:
            i, j = self.label[i], self.label[j]
            apart = i != j
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.label, np.maximum(i, j), np.minimum(i, j))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, labels) of those that are not their own label."""
        some = np.flatnonzero(self.label != np.arange(len(self.label)))
        return some, self.label[some]


class Forest:
    """Union-find over the few rows that one task compares."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def stars(self):
        """(member, root) for each member that is not its own root."""
        return [(x, self.find(x)) for x in list(self.up) if self.find(x) != x]
