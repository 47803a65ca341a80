"""Tables in the folder that the driver and all executors share: what cuts lineage, survives executors, and is taken away again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Only on a local master, as in tests, is one made where it is unset."""
    if named := spark.conf.get(CHECKPOINT_DIR, None):
        return named.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if context.master.split("[")[0] != "local":
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


class Held:
    """Tables that a computation writes on its way; `close` deletes them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.path = f"{folder(spark)}/held/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        self.n = 0

    def written(self, df: DataFrame) -> DataFrame:
        """`df` written and read again."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
