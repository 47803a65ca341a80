"""Deposits: what a folder says of its files, held against the files before any of them is handed on."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks
from .readers import FILES, file_listing

# The files that a deposit has beside its artifacts, and the version of its manifest.
MANIFEST, METADATA, README, RECORD, VERSION = "manifest.json", "metadata.json", "README.md", "model.json", 1
RESERVED = (MANIFEST, METADATA, README, RECORD)


@dataclass(frozen=True)
class Deposit:
    """A deposit that holds: its metadata, where it goes, and (name, size_bytes, sha256) of all files to hand on."""

    metadata: dict
    community: str
    requirements: dict
    files: DataFrame


def _document(spark: SparkSession, path: str) -> dict:
    found = json.loads(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
    if not isinstance(found, dict):
        raise checks.DataError(f"{path} isn't an object")
    return found


def _said(artifacts: object) -> list[tuple[str, int, str]]:
    """The artifacts as a manifest lists them."""
    if not isinstance(artifacts, list) or not artifacts or not all(isinstance(a, dict) for a in artifacts):
        raise checks.DataError("a manifest lists artifacts, one at least")
    rows = []
    for a in artifacts:
        size = a.get("size_bytes")
        if set(a) != {"name", "size_bytes", "sha256"} or not isinstance(a["name"], str) or not isinstance(size, int) or isinstance(size, bool) or size < 0:
            raise checks.DataError(f"an artifact has a name, a size and a digest, not {a}")
        rows.append((a["name"], size, str(a["sha256"])))
    names = [n for n, *_ in rows]
    if repeated := sorted({n for n in names if names.count(n) > 1}):
        raise checks.DataError(f"artifacts are listed twice: {repeated}")
    if taken := sorted(set(names) & set(RESERVED)):
        raise checks.DataError(f"artifacts can't have the names of a deposit's own files: {taken}")
    return rows


def table_lines(spark: SparkSession, path: str) -> Sequence[int]:
    """Numbers, from 1, of lines that separate a Markdown table's head outside fenced code."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("i", "line"))
    found = checks.tables_outside_fences(text.select(F.lit("").alias("d"), (F.col("i") + 1).alias("at"), "line"), "d", "at", "line").first()
    return found["lines"] if found else []


def load_deposit(spark: SparkSession, directory: str, artifact_directory: str) -> Deposit:
    """A deposit's folder and the folder of its artifacts, checked whole.

    Its manifest has a version, a community, artifacts and what inference needs; a read-me without tables and a model's
    record are there; every artifact has the size and the digest that it should, hashed where it is read; and a
    preview, if the metadata name one, is one of the files. Files beside the artifacts aren't looked at."""
    own = {r["name"] for r in file_listing(spark, directory).select("name").filter(F.col("name").isin(*RESERVED)).collect()}
    if lacking := sorted(set(RESERVED) - own):
        raise FileNotFoundError(f"{directory} lacks {lacking}")
    manifest, metadata = (_document(spark, f"{directory}/{n}") for n in (MANIFEST, METADATA))
    if manifest.get("schema_version") != VERSION or isinstance(manifest.get("schema_version"), bool):
        raise checks.DataError(f"manifests of version {manifest.get('schema_version')} can't be read")
    community, needs = manifest.get("community"), manifest.get("inference_requirements")
    if not isinstance(community, str) or not community:
        raise checks.DataError("a deposit goes to a community")
    if not isinstance(needs, dict) or not needs:
        raise checks.DataError("a deposit says what inference needs")
    listed = spark.createDataFrame(_said(manifest.get("artifacts")), FILES)
    if lines := table_lines(spark, f"{directory}/{README}"):
        raise checks.DataError(f"{README} has tables, which aren't shown, at lines {', '.join(map(str, lines))}")
    present = file_listing(spark, artifact_directory).join(listed.select("name"), "name", "left_semi")
    checks.require(checks.reconcile(listed, present))
    files = file_listing(spark, directory).filter(F.col("name").isin(README, MANIFEST, RECORD)).unionByName(present)
    preview = (metadata.get("files") or {}).get("default_preview")
    if preview is not None and preview not in {README, MANIFEST, RECORD} | {n for n, *_ in _said(manifest["artifacts"])}:
        raise checks.DataError(f"the preview {preview} isn't one of the files")
    return Deposit(metadata, community, needs, files)
