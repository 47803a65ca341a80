"""Vector code compression: each vector's parts as numbers of their nearest codebook entries.

Components become integers, so equal parts are common: of each position the distinct parts, with how often they come,
are all that Lloyd's rounds read. A round's sums are those of a few entries for each position, so the driver sees
no more than the codebooks. Codes and errors of distinct parts are then joined back to vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers beyond are this far at most, so that squared distances of wide vectors stay longs.
FARTHEST = 1 << 27
#: Differences of parts and entries that a task holds at once.
STEP = 1 << 20

Codebooks = list[np.ndarray]


def _finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integer_vectors(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, scale: float = SCALE) -> DataFrame:
    """The rows whose vectors can be cut into parts, with `whole`: floor(scale * x) of each component.

    Null and empty vectors, those with null or non-finite components, and lengths that `parts` doesn't divide are
    left out."""
    v = F.col(vector)
    cut = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & _finite(v)
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(FARTHEST)), F.least(F.lit(float(FARTHEST)), x.cast("double") * scale))).cast("int"))
    return vectors.filter(cut).withColumn("whole", whole)


def first_codebooks(rows: DataFrame, id_: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """Of each position, that part of the vectors with the smallest ids, ascending; nulls last, ties by the vector.

    Vectors as long as that of the smallest id count. No rows: no codebooks."""
    some = rows.orderBy(F.col(id_).asc_nulls_last(), "whole").select("whole")
    if not (first := some.first()):
        return []
    found = np.array([r.whole for r in some.filter(F.size("whole") == len(first.whole)).limit(entries).collect()], np.int64)
    return [np.ascontiguousarray(p) for p in np.split(found, parts, axis=1)]


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each part's nearest entry, the lowest of equally near ones, and its squared distance."""
    codes, errors, step = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), max(1, STEP // book.size)
    for at in range(0, len(part), step):
        far = ((part[at : at + step, None] - book[None]) ** 2).sum(axis=2)
        codes[at : at + step] = far.argmin(axis=1)
        errors[at : at + step] = far.min(axis=1)
    return codes, errors


def _by_position(batch: pd.DataFrame):
    for position, rows in batch.groupby("position", sort=False):
        yield int(position), rows, np.array(rows["part"].tolist(), np.int64)


def _sums(books: Codebooks):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for position, rows, part in _by_position(batch):
                codes, _ = nearest(part, books[position])
                n, total = np.zeros(len(books[position]), np.int64), np.zeros_like(books[position])
                np.add.at(n, codes, rows["n"].to_numpy())
                np.add.at(total, codes, part * rows["n"].to_numpy()[:, None])
                used = np.flatnonzero(n)
                yield pd.DataFrame({"position": position, "entry": used, "n": n[used], "total": total[used].tolist()})

    return sums


def lloyd_round(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks whose entries are floor(mean) of the parts nearest to them; entries without any stay."""
    width = books[0].shape[1]
    each = distinct.mapInPandas(_sums(books), "position int, entry int, n long, total array<long>")
    summed = each.groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(j))) for j in range(width)]).alias("total"))
    out = [b.copy() for b in books]
    for r in summed.collect():  # one row for each entry of a codebook
        out[r.position][r.entry] = [t // r.n for t in r.total]
    return out


def _codes(books: Codebooks):
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows, part in _by_position(batch):
                codes, errors = nearest(part, books[int(rows["position"].iloc[0])])
                yield pd.DataFrame({"position": rows["position"], "part": rows["part"], "entry": codes, "off": errors})

    return code


def cut_parts(parts: int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(i.alias("position"), F.slice("whole", i * width + 1, width).alias("part")))


def compress(
    vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE
) -> tuple[DataFrame, Codebooks]:
    """The rows of `vectors` that can be coded, with `entries` (array of numbers in the order of parts) and `error`
    (squared distances from the entries, summed), and the codebooks.

    Rows that `integer_vectors` leaves out, and those not as long as the vector of the smallest id, are not
    returned. Repeated rows are counted as often as they come and each returned."""
    rows = integer_vectors(vectors, vector, parts, scale)
    books = first_codebooks(rows, id_, parts, entries)
    if not books:
        return rows.drop("whole").withColumns({"entries": F.array().cast("array<int>"), "error": F.lit(0).cast("long")}).limit(0), books
    width = books[0].shape[1]
    rows = rows.filter(F.size("whole") == parts * width).withColumn("_of", F.unhex(F.md5(F.array_join("whole", ",").cast("binary"))))
    # equal vectors are cut once; how often they come is what their parts weigh
    each = rows.groupBy("_of").agg(F.first("whole").alias("whole"), F.count("*").alias("n"))
    each = written(each.select("_of", "n", F.explode(cut_parts(parts, width)).alias("p")).select("_of", "n", "p.*"), "vector-parts")
    distinct = written(each.groupBy("position", "part").agg(F.sum("n").alias("n")), "vector-distinct")
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    coded = distinct.select("position", "part").mapInPandas(_codes(books), "position int, part array<int>, entry int, off long")
    back = each.drop("n").join(coded, ["position", "part"]).groupBy("_of")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda p: p["entry"])
    back = back.agg(ordered.alias("entries"), F.sum("off").alias("error"))
    return rows.drop("whole").join(back, "_of").drop("_of"), books


def decoded(entries: Column, books: Codebooks, scale: float = SCALE) -> Column:
    """The vector that `entries` stand for: the middle of each integer's range, over the scale."""
    known = F.array(*[F.array(*[F.array(*[F.lit((int(x) + 0.5) / scale) for x in e]) for e in b]) for b in books])
    return F.flatten(F.zip_with(known, entries, lambda book, i: F.get(book, i)))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    coded, books = compress(vectors)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    code = F.lower(F.array_join(F.transform("entries", lambda e: F.lpad(F.hex(e), 2, "0")), ""))
    rows = written(coded.select("vec_id", "label", code.alias("code"), "error"), "vector-codes")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    found = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
