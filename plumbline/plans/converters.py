"""From a published dataset to a sealed snapshot: labels and an archive of structures become samples with groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, features, lookups
from ..sources import readers, writers


def formula_parts(structures: DataFrame) -> DataFrame:
    """(sample_id, element, amount) of CIF files (sample_id, content), from the sum formula that each states.

    A file without one has a single row without an element, so that it isn't lost."""
    text = F.decode("content", "UTF-8")
    stated = F.regexp_extract(text, r"(?m)^\s*_chemical_formula_sum\s+(?:'([^'\n]*)'|\"([^\"\n]*)\"|(\S+))", 0)
    inner = F.regexp_replace(F.regexp_replace(stated, r"^\s*_chemical_formula_sum\s+", ""), "['\"]", "")
    words = F.filter(F.split(F.trim(inner), r"\s+"), lambda w: w.rlike(r"^[A-Z][a-z]?[0-9.]*$"))
    # a word that is no element with an amount makes the whole unknown
    whole = F.when((F.size(words) > 0) & (F.size(words) == F.size(F.split(F.trim(inner), r"\s+"))), words)
    said = structures.select("sample_id", F.explode_outer(whole).alias("w"))
    amount = F.regexp_extract("w", r"([0-9.]*)$", 1)
    return said.select("sample_id", F.regexp_extract("w", "^([A-Z][a-z]?)", 1).alias("element"), F.when(amount == "", 1.0).otherwise(amount.try_cast("double")).alias("amount")).withColumn(
        "element", F.when(F.col("element") != "", F.col("element"))
    )


def convergence_snapshot(
    spark: SparkSession, summary: str, archive: str, output: str, header: dict, digests: tuple[str, str] | None = None, folder: str = "CIF_files"
) -> dict:
    """Writes a snapshot of the labels of `summary`, each sample's group the reduced formula of its structure in `archive`.

    `digests` are those that the two files must have. Labels must be unique, safe names with whole numbers; every labelled sample needs a
    structure with a formula, unlabelled structures are left out; a folder with content is refused. Structures stay where they are: only labels, groups and
    the manifest are written. Gives the numbers of samples, groups and samples by label, and the manifest."""
    for path, digest in zip((summary, archive), digests or ()):
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
        if found != digest:
            raise checks.DataError(f"{path} has the digest {found}, not {digest}")
    labels = readers.convergence_summary(spark, summary)
    members = readers.archive_members(spark, archive, folder)
    parts = formula_parts(lookups.subset(members, labels, "sample_id"))
    groups = features.reduced_formula(parts, "sample_id").persist()
    try:
        repeated = members.groupBy("sample_id").count().filter("count > 1").agg(F.count("*").alias("repeated_structures"))
        lacking = labels.join(groups, "sample_id", "left").agg(F.count_if(F.col("formula").isNull()).alias("samples_without_formula"), F.when(F.count("*") == 0, 1).otherwise(0).alias("no_labels"))
        checks.require(lacking.crossJoin(repeated))
        rows = labels.join(groups, "sample_id").select("sample_id", "target", "formula")
        writers.prepare_directory(spark, output)
        writers.write_file(rows.orderBy("sample_id"), f"{output}/id_prop.csv", header=False)
        sizes = rows.groupBy("target").count().orderBy("target").collect()
        n_groups = rows.agg(F.count_distinct("formula")).first()[0]
    finally:
        groups.unpersist()
    manifest = writers.seal(spark, output, header)
    return {"samples": sum(r["count"] for r in sizes), "groups": n_groups, "labels": {r["target"]: r["count"] for r in sizes}, "manifest": manifest}
