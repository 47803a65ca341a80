"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import BATCH_BYTES, batches_of, table, written
from plumbline.llm.decontam import drop_contaminated
from plumbline.llm.near_text import drop_near_text
from plumbline.llm.packing import digests, pack
from plumbline.llm.secrets import redact_secrets
from plumbline.llm.toxicity import drop_toxic


#: Bytes of a batch on its way to Python, at most: workers of all stages stand in an executor's memory together.
BATCH = 1 << 24


def _bounded(spark: SparkSession) -> None:
    """From here on this session hands tables to Python in batches of `BATCH` bytes at most.

    What a stage returns is run later, so a stage alone leaves the session like this; `run` sets it back."""
    if int(spark.conf.get(BATCH_BYTES).rstrip("b")) > BATCH:
        spark.conf.set(BATCH_BYTES, str(BATCH))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar rejects go."""
    _bounded(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of five-word shingles), the document with the smallest doc_id stays."""
    _bounded(spark)
    return drop_near_text(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are a twentieth or more go."""
    _bounded(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced."""
    _bounded(spark)
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    _bounded(spark)
    return digests(pack(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("simhash", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", packing),
]

#: Fingerprints, the grammar and the packing have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    with batches_of(spark, int(spark.conf.get(BATCH_BYTES).rstrip("b"))):
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
