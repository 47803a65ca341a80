"""Readers with fixed schemas. Nothing is inferred; what can be wrong in a file is a column or an error."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import checks

SAMPLE = T.StructType(
    [
        T.StructField("sample_id", T.StringType(), False), T.StructField("target_num", T.DoubleType()),
        T.StructField("target_label", T.StringType()), T.StructField("group", T.StringType()),
    ]
)
# The keys of a snapshot's manifest.
MANIFEST_KEYS = {"schema_version", "record_id", "snapshot_version", "target", "structure_suffix", "features_file", "files"}
FILES = "name string, size_bytes long, sha256 string"


def sample_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n_fields, sample_id, target, group) of a file without a header: id, target and, maybe, group.

    Fields are trimmed; blank lines and lines of empty fields are left out; an absent third field is null,
    an empty one stays empty. Lines that CSV quoting would join aren't part of the format."""
    fields = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = spark.read.text(path).select(fields.alias("f")).filter(F.exists("f", lambda x: x != ""))
    return rows.select(F.size("f").alias("n_fields"), F.get("f", 0).alias("sample_id"), F.get("f", 1).alias("target"), F.get("f", 2).alias("group"))


def typed_samples(lines: DataFrame, task: str, threshold: float | None = None, positive: str = "positive", negative: str = "negative") -> DataFrame:
    """Samples with a number or a label as target. With a threshold, numbers are parsed first and classed then."""
    number = F.when(F.lit(task == "regression" or threshold is not None), F.col("target").try_cast("double"))
    label = F.when(number >= threshold, positive).otherwise(negative) if threshold is not None else F.when(F.lit(task != "regression"), F.col("target"))
    return lines.select("sample_id", number.alias("target_num"), label.alias("target_label"), "group")


def sample_ids(spark: SparkSession, path: str) -> DataFrame:
    return sample_lines(spark, path).select("sample_id")


def feature_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(sample_id, columns...) of a file with a header; a number that isn't finite is an error naming it."""
    header = spark.read.text(path).first()
    names = [x.strip() for x in header[0].split(",")] if header else []
    if not names or names[0] != "sample_id" or len(set(names)) != len(names):
        raise checks.DataError(f"{path}: the header must be sample_id and names that differ")
    if missing := [c for c in columns if c not in names]:
        raise checks.DataError(f"{path}: no columns {missing}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    number = checks.strict_number
    wrong = [F.when(number(F.col(c)).isNull(), F.raise_error(F.concat(F.lit(f"{c} of "), F.col("sample_id"), F.lit(" isn't a number"))).cast("double")).otherwise(number(F.col(c))).alias(c) for c in columns]
    return rows.select(F.trim("sample_id").alias("sample_id"), *wrong)


def file_listing(spark: SparkSession, directory: str, pattern: str = "*", deep: bool = False) -> DataFrame:
    """(name, size_bytes, sha256) of a flat folder's files, hashed where they are read; or of those at any depth, their
    names then with the folders below `directory`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", deep).load(directory)
    name = F.element_at(F.split("path", "/"), -1)
    if deep:
        top = spark._jvm.org.apache.hadoop.fs.Path(directory)
        root = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()
        name = F.substring(F.col("path"), F.lit(len(root) + 2), F.length("path"))
    return files.select(name.alias("name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


@dataclass(frozen=True)
class Snapshot:
    """Verified samples with what identifies them."""

    samples: DataFrame
    record_id: str
    version: str
    digest: str
    target: dict = field(default_factory=dict)
    has_features: bool = False
    has_structures: bool = False
    has_groups: bool = False

    def identity(self) -> dict:
        return {"record_id": self.record_id, "snapshot_version": self.version, "manifest_sha256": self.digest, "target": self.target}


def read_manifest(spark: SparkSession, directory: str) -> tuple[dict, str]:
    """A manifest's content and its own digest. Keys that aren't known are an error."""
    row = spark.read.format("binaryFile").load(f"{directory}/manifest.json").select("content", F.sha2("content", 256).alias("sha256")).first()
    document = json.loads(bytes(row["content"]))
    if unknown := set(document) - MANIFEST_KEYS:
        raise checks.DataError(f"unknown manifest keys: {sorted(unknown)}")
    return document, row["sha256"]


def load_snapshot(spark: SparkSession, directory: str, task: str, target: tuple[str, str, str] | None = None, needs: Sequence[str] = (), threshold: float | None = None) -> Snapshot:
    """A folder with a manifest, `id_prop.csv` and maybe features and structures, checked whole before it is used.

    `target` is the (name, contract, units) that the caller expects; `needs` names capabilities out of
    features, structures and groups. All violations of a kind are counted and raised together."""
    document, digest = read_manifest(spark, directory)
    listed = spark.createDataFrame([(f["name"], int(f["size_bytes"]), f["sha256"]) for f in document["files"]], FILES)
    present = file_listing(spark, directory).filter("name <> 'manifest.json'")
    checks.require(checks.reconcile(listed, present, ["id_prop.csv"]))
    found = document.get("target") or {}
    if target and (found.get("name"), found.get("contract"), found.get("units")) != tuple(target):
        raise checks.DataError(f"the snapshot's target is {found}, not {target}")
    lines = sample_lines(spark, f"{directory}/id_prop.csv")
    checks.require(checks.sample_rules(lines, "regression" if threshold is not None else task))
    if checks.consecutive_ids(lines, "sample_id").first()["consecutive"]:
        raise checks.DataError("ids are row positions")
    snapshot = Snapshot(
        typed_samples(lines, task, threshold), document["record_id"], document["snapshot_version"], digest, found,
        bool(document.get("features_file")), bool(document.get("structure_suffix")), bool(checks.capabilities(lines, "group").first()["has_groups"]),
    )
    lacking = [n for n in needs if not getattr(snapshot, f"has_{n}")]
    if lacking:
        raise checks.DataError(f"the snapshot has no {', '.join(lacking)}")
    return snapshot


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, split) of a file whose header is exactly these two names."""
    header = spark.read.text(path).first()
    if not header or header[0].strip() != "sample_id,split":
        raise checks.DataError(f"{path}: the header must be sample_id,split")
    return spark.read.schema("sample_id string, split string").csv(path, header=True, enforceSchema=False)


# The header of such summaries.
SUMMARY = ("source_db_id", "k_index", "k_dist_interval", "k_mesh")


def convergence_summary(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, target) of a labelled summary; the header is fixed, ids are unique names, targets whole numbers from 0."""
    header = spark.read.text(path).first()
    if not header or tuple(header[0].strip().split(",")) != SUMMARY:
        raise checks.DataError(f"{path}: the header must be {','.join(SUMMARY)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in SUMMARY])
    rows = spark.read.schema(schema).csv(path, header=True, quote='"', enforceSchema=False).select(F.trim("source_db_id").alias("sample_id"), F.trim("k_index").alias("k"))
    whole = F.when(F.col("k").rlike("^[0-9]{1,18}$"), F.col("k").cast("long"))
    counts = rows.agg(
        (F.count("*") - F.count_distinct(F.coalesce("sample_id", F.lit("")))).alias("repeated_ids"),
        F.count_if(~F.coalesce(checks.safe_name(F.col("sample_id")), F.lit(False))).alias("unsafe_ids"), F.count_if(whole.isNull()).alias("bad_targets"),
    )
    checks.require(counts)
    return rows.select("sample_id", whole.alias("target"))


def _members(folder: str, suffix: str):
    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                    for member in archive:
                        path = PurePosixPath(member.name)
                        if member.isdir() and path == PurePosixPath(folder):
                            continue
                        if path.is_absolute() or ".." in path.parts or not member.isfile() or path.parent != PurePosixPath(folder) or path.suffix != suffix:
                            raise checks.DataError(f"unexpected archive member {member.name}")
                        yield pd.DataFrame({"sample_id": [path.stem], "content": [archive.extractfile(member).read()]})

    return members


def archive_members(spark: SparkSession, path: str, folder: str, suffix: str = ".cif") -> DataFrame:
    """(sample_id, content) of the files of tar archives: a member is one row.

    An archive is read whole by one task, as one value, so it has 2 GB at most; larger ones are to be split."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_members(folder, suffix), "sample_id string, content binary")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files, compressed or not: an array or a line each. A file is one task's, read as one value."""
    return spark.read.schema(schema).json(path, multiLine=True)


def structures_in_batches(spark: SparkSession, directory: str, suffix: str = ".cif") -> DataFrame:
    """(sample_id, text) of structure files; featurizers take them in Arrow batches (see `plans.models`)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(directory)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("sample_id"), F.col("content").cast("string").alias("text"))
