"""Writers in fixed orders, so that the same run writes the same bytes; manifests of what was written."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks
from .readers import file_listing

# The columns of predictions, in order, and the files of a bundle that tell when and where it was made.
PREDICTIONS = ("sample_id", "split", "source", "truth", "prediction", "score", "lower", "upper")
PROVENANCE = ("run.json", "environment.json")
MARKER = ".plumbline-run"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file of a report, in whichever store Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_file(rows: DataFrame, path: str, header: bool = True) -> None:
    """A CSV file of rows in their order: the one part that Spark writes, under a name of its own."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = f"{path}.parts"
    rows.coalesce(1).write.mode("overwrite").csv(folder, header=header, nullValue="", emptyValue="")
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = [f.getPath() for f in store.listStatus(hadoop(folder)) if f.getPath().getName().startswith("part-")]
    store.rename(part[0], hadoop(path))
    store.delete(hadoop(folder), True)


def write_splits(assignment: DataFrame, path: str, single: bool = True) -> None:
    """A table of (sample_id, split) by id. One file is a report's form; `single=False` keeps ranges of ids apart."""
    ordered = assignment.select("sample_id", "split").orderBy("sample_id")
    (ordered.coalesce(1) if single else ordered).write.csv(path, header=True)


def write_predictions(preds: DataFrame, path: str, single: bool = True) -> None:
    """Predictions by source and id, nulls as empty fields; columns that `preds` lacks are left out."""
    ordered = preds.select(*[c for c in PREDICTIONS if c in preds.columns]).orderBy("source", "sample_id")
    (ordered.coalesce(1) if single else ordered).write.csv(path, header=True, nullValue="", emptyValue="")


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line, added to what is there."""
    rows.write.mode("append").json(path)


def write_json(path: str, document: dict, spark: SparkSession | None = None) -> None:
    """A document as JSON with sorted keys; with a session in any store, else in the driver's folder."""
    text = json.dumps(document, indent=2, sort_keys=True) + "\n"
    if spark:
        write_text(spark, path, text)
    else:
        Path(path).write_text(text)


def manifest_frame(spark: SparkSession, directory: str, provenance: Sequence[str] = PROVENANCE) -> DataFrame:
    """(name, size_bytes, sha256, deterministic) of a bundle's files, without the manifest itself."""
    files = file_listing(spark, directory).filter("name <> 'manifest.json' and not startswith(name, '.')")
    return files.withColumn("deterministic", ~F.col("name").isin(*provenance))


def stable_digest(files: DataFrame) -> DataFrame:
    """(digest, n): SHA-256 over name:sha256 lines, by name, of what doesn't depend on when or where it ran."""
    some = files.filter("deterministic")
    lines = F.array_sort(F.collect_list(F.struct("name", "sha256")))
    text = F.concat_ws("", F.transform(lines, lambda f: F.concat(f["name"], F.lit(":"), f["sha256"], F.lit("\n"))))
    return some.agg(F.sha2(text.cast("binary"), 256).alias("digest"), F.count("*").alias("n"))


def write_manifest(spark: SparkSession, directory: str) -> dict:
    """Lists a bundle's files, a handful, and writes `manifest.json` beside them."""
    files = manifest_frame(spark, directory)
    rows = files.orderBy("name").collect()
    document = {
        "files": [{"name": r["name"], "size_bytes": r["size_bytes"], "sha256": r["sha256"]} for r in rows],
        "deterministic_digest": stable_digest(files).first()["digest"],
        "non_deterministic_files": [r["name"] for r in rows if not r["deterministic"]],
    }
    write_json(f"{directory}/manifest.json", document, spark)
    return document


def seal(spark: SparkSession, directory: str, header: dict, structure_suffix: str | None = None) -> dict:
    """Writes the manifest of a new snapshot. Structure files must be there for all samples or for none."""
    from .readers import sample_ids

    files = file_listing(spark, directory).filter("name <> 'manifest.json' and not startswith(name, '.')")
    if structure_suffix:
        ids = sample_ids(spark, f"{directory}/id_prop.csv").select(F.concat("sample_id", F.lit(structure_suffix)).alias("name"))
        some = files.filter(F.col("name").endswith(structure_suffix)).select("name")
        lacking = ids.join(some, "name", "left_anti").agg(F.count("*").alias("samples_without_structure"))
        checks.require(lacking.crossJoin(some.join(ids, "name", "left_anti").agg(F.count("*").alias("structures_without_sample"))))
    rows = files.orderBy("name").collect()
    document = header | {"files": [r.asDict() for r in rows], "structure_suffix": structure_suffix}
    write_json(f"{directory}/manifest.json", document, spark)
    return document


def prepare_directory(spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """An empty folder for a run, in whichever store Spark reaches. One with content is only cleared if asked for,
    and if a run of ours made it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(folder) and len(store.listStatus(folder)):
        if not overwrite or not store.exists(hadoop(f"{path}/{MARKER}")):
            raise FileExistsError(f"{path} isn't empty" + (" and wasn't made by a run" if overwrite else ""))
        store.delete(folder, True)
    store.mkdirs(folder)
    # a local store would put a checksum beside the mark
    store.setWriteChecksum(False)
    try:
        write_text(spark, f"{path}/{MARKER}", "")
    finally:
        store.setWriteChecksum(True)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
