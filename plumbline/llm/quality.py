"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .toxicity import labelled_sample

#: Hashed unigrams and bigrams share `SPREAD` buckets for each square root of a byte of all texts, as distinct words
#: grow, in a power of two that is this at least: some 2**19 at 30 GB and 2**25, 256 MB in a task, at 100 TB.
SPREAD, LEAST_BUCKETS = 2, 1 << 14
#: Labelled rows of good quality that the target model is fitted on, at most.
SAMPLE = 20_000
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Share of all documents that the sample keeps.
SHARE = 0.5
SEED = 3
REMEMBERED = 200_000

ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def bucket_count(docs: DataFrame) -> int:
    """How many buckets the models of these texts have: it grows with them, at every size."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BUCKETS, 1 << (SPREAD * math.isqrt(size)).bit_length())


def buckets(text: str | None, n: int) -> np.ndarray:
    """The bucket, out of n, of each word and of each two consecutive words; words are parted by ASCII white space, A-Z lowered."""
    words = text.encode().lower().split() if text else []
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    pairs = h[:-1] * ODD + h[1:]
    pairs ^= pairs >> np.uint64(31)
    return (np.concatenate((h, pairs * ODD)) >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)


def _counter(n: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for text in batch["text"]:
                found, times = np.unique(buckets(text, n), return_counts=True)
                total[found] += times
        there = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": there, "n": total[there]})

    return count


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"bucket": [batch["bucket"].to_numpy("<i4").tobytes()], "n": [batch["n"].to_numpy("<i8").tobytes()]})


def model(docs: DataFrame, n: int) -> np.ndarray:
    """The smoothed log probability of each of n buckets over all texts of `docs`.

    A task counts what it reads in one array, so a bucket and task make one row of the shuffle; sums come
    to the driver as packed arrays, 12 bytes for each bucket."""
    counts = docs.select("text").mapInPandas(_counter(n), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.full(n, SMOOTHING)
    for r in counts.mapInPandas(_packed, "bucket binary, n binary").collect():
        total[np.frombuffer(r["bucket"], "<i4")] += np.frombuffer(r["n"], "<i8")
    return np.log(total / total.sum())


def weigh(docs: DataFrame, target: np.ndarray, raw: np.ndarray, seed: int = SEED) -> DataFrame:
    """`docs` with log_weight, the log ratio of the two models over the text's n-grams, and key, to sample by.

    The key is the log weight plus Gumbel noise that depends on doc_id, text and seed alone, so that a
    task run again draws the same. A text without words has weight 1 (log 0)."""
    ratio = docs.sparkSession.sparkContext.broadcast(target - raw)

    def log_weight(texts: pd.Series) -> pd.Series:
        r = ratio.value
        return pd.Series([float(r[buckets(t, len(r))].sum()) for t in texts], dtype="float64")

    log_weight.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    noise = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    uniform = (F.shiftrightunsigned(noise, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    gumbel = -F.log(-F.log(uniform))
    return docs.withColumn("log_weight", F.round(F.pandas_udf(log_weight, "double")("text"), 9)).withColumn("key", F.col("log_weight") + gumbel)


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column without nulls; None where there are fewer rows.

    A radix search: each of four passes counts rows by 16 more bits, at most 65,536 values, however many
    rows there are."""
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        rows = keys if prefix is None else keys.filter(F.shiftright(column, shift + 16) == prefix)
        counts = rows.groupBy(F.shiftright(column, shift).alias("digits")).count().collect()
        for digits, n in sorted(((r["digits"], r["count"]) for r in counts), reverse=True):
            if left <= n:
                prefix = digits
                break
            left -= n
        else:
            return None
    return prefix


def resample(docs: DataFrame, target: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): log_weight, sample_key (in millionths) and selected.

    The raw model counts all of `docs`, the target model the rows of `target` (text). Selected are the
    rows with the largest keys, `share` of all: sampling without replacement in proportion to the
    importance weights. Rows that tie with the last one selected are selected too, so that repeated rows
    fare alike. Null and empty texts have log weight 0; an empty target tells nothing, and then all log
    weights are 0. Scores are written once; texts are read for the models and for the scores."""
    n = bucket_count(docs)
    raw, wanted = model(docs, n), model(target, n)
    if np.ptp(wanted) == 0:
        wanted = raw
    keyed = weigh(docs.select("doc_id", "text"), wanted, raw, seed)
    scored = written(keyed.select("doc_id", "log_weight", F.round(F.col("key") * 1e6).cast("long").alias("sample_key")), "quality")
    least = kth_largest(scored, "sample_key", math.ceil(share * scored.count()))
    return scored.withColumn("selected", F.lit(False) if least is None else F.col("sample_key") >= least)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    target = labelled_sample(docs, labels.filter("quality > 0"), "quality", SAMPLE)
    return resample(docs, target)
