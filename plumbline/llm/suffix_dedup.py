"""Repeated passages: every byte that a string of 100 bytes covers which also starts earlier in the corpus.

Bucket-pointer refinement. A bucket holds the places whose next bytes are equal, and its number is made of the
numbers of the buckets that two of its offsets fall into: those of 16 bytes of two of 8, those of 32 of two of 16.
Of all suffixes only some start the work: each window of 100 bytes has the place of its least 32-byte bucket, the
same one in each equal window, and consecutive windows of one such place are a run (one place for some 32 bytes).

Initial buckets are those of 32 bytes at the runs' places. A bucket that one run alone is in holds no repeat and
leaves. One whose runs all have equal bytes needs no more either: all but the first run repeat. The others are
refined: runs of equal bytes first, then the windows of what remains, whose numbers of 100 bytes are pairs of
the numbers at a later offset again. Groupings are aggregations and joins, so no bucket is one task's."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, table, written

LENGTH = 100
#: Bytes of an initial bucket.
BUCKET = 32
#: Bytes of text whose buckets are numbered at once, and of a batch on its way to Python.
STEP, BATCH_BYTES = 1 << 20, 1 << 24
#: Runs of one bucket that are refined in one group; the windows of larger buckets are rows of their own.
PART = 1 << 12
NO_ID = -(1 << 63)

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def paired(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """The number of the bucket that holds what is in bucket `first` and, at a later offset, in bucket `later`."""
    x = first * _A + later * _B + _C
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(29)
    return x


def refined(numbers: np.ndarray, offset: int) -> np.ndarray:
    return paired(numbers[: len(numbers) - offset], numbers[offset:])


def buckets(data: np.ndarray) -> np.ndarray:
    """The number of the 32-byte bucket of each place."""
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel()
    return refined(refined(eight, 8), 16)


def windows(numbers: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The numbers of the buckets of `length` bytes, from those of 32."""
    have = BUCKET
    while have < length:
        step = min(have, length - have)
        numbers, have = refined(numbers, step), have + step
    return numbers


def least_places(numbers: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each `width` numbers, the leftmost of equal ones."""
    least, place, have = numbers, np.arange(len(numbers)), 1
    while have < width:
        step = min(have, width - have)
        left = least[:-step] <= least[step:]
        least, place, have = np.where(left, least[:-step], least[step:]), np.where(left, place[:-step], place[step:]), have + step
    return place


def _runs(data: np.ndarray, owner: np.ndarray, ends: np.ndarray, length: int):
    """bucket, bytes' number, owner, first window, last window of the runs of joined texts; `owner` and `ends` say whose a place is and where it ends."""
    numbers = buckets(data)
    places = least_places(numbers, length - BUCKET + 1)
    whole = np.arange(len(places)) + length <= ends[: len(places)]
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] != places[:-1]) | (owner[1 : len(places)] != owner[: len(places) - 1])
    first = np.flatnonzero(new & whole)
    nxt = np.flatnonzero(np.diff(np.concatenate((np.cumsum(new)[whole], [0]))) != 0)
    last = np.flatnonzero(whole)[nxt]
    full = windows(numbers, length)
    extent = ((places[first] - first) * (2 * length) + last - first).astype(np.uint64)
    return numbers[places[first]], paired(paired(full[first], full[last]), extent), owner[first], first, last


def runs(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """bucket, bytes' number, text, start and end of each run: the windows that start there up to `length` before its end.

    Texts are numbered some at a time and long ones piece by piece, pieces overlapping by a window less a byte."""
    found: list[tuple] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def number() -> None:
        sizes = np.array([len(b) for *_, b in held])
        data = np.frombuffer(b"".join(b for *_, b in held), np.uint8)
        bucket, same, at, first, last = _runs(data, np.repeat(np.arange(len(held)), sizes), np.repeat(np.cumsum(sizes), sizes), length)
        shift = np.array([o for _, o, _ in held]) - (np.cumsum(sizes) - sizes)
        found.append((bucket.view(np.int64), same.view(np.int64), np.array([i for i, *_ in held])[at], first + shift[at], last + shift[at] + length))
        held.clear()

    for i, text in enumerate(texts):
        for o in range(0, max(1, len(text) - length + 1), STEP):
            piece = text[o : o + STEP + length - 1]
            if len(piece) >= length:
                held.append((i, o, piece))
                size += len(piece)
            if size >= STEP:
                number()
                size = 0
    if held:
        number()
    return tuple(np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else [()] * 5))


def _sorted_runs(batch: pd.DataFrame, length: int):
    """The runs of a batch whose documents are put in order, so that what comes first is earlier; rank and d of its documents."""
    batch = batch.sort_values(["rank", "d"], kind="stable")
    return *runs([t.encode() for t in batch["text"]], length), batch["rank"].to_numpy(), batch["d"].to_numpy()


def _heads(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


BUCKETS = "bucket long, n long, low long, high long, first long"


def _count(length: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What each bucket holds: runs, the least and greatest number of their bytes, the first document."""
        for batch in batches:
            bucket, same, text, _, _, rank, _ = _sorted_runs(batch, length)
            order = np.argsort(bucket, kind="stable")
            bucket, same, rank = bucket[order], same[order], rank[text[order]]
            if len(bucket):
                at = _heads(bucket)
                yield pd.DataFrame(
                    {"bucket": bucket[at], "n": np.diff(np.append(at, len(bucket))), "low": np.minimum.reduceat(same, at), "high": np.maximum.reduceat(same, at), "first": rank[at]}
                )

    return count


#: A run, or with `same` null a part [start, end) of a text that repeats for sure; `at` is start * 2^32 + end.
OCCURRENCES = "key long, same long, rank long, d int, at long"


def joined_parts(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted parts of texts with those that touch made one."""
    if not len(text):
        return text, start, end
    far = end.copy()
    for a, b in zip(at := _heads(text), np.append(at[1:], len(text))):
        far[a:b] = np.maximum.accumulate(end[a:b])
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] > far[:-1])
    at = np.flatnonzero(new)
    return text[at], start[at], far[np.append(at[1:], len(text)) - 1]


def _repeating(group: np.ndarray, rank: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of rows in order of group, document and start: which have an earlier one in their group."""
    at = _heads(group)
    first = np.repeat(rank[at], np.diff(np.append(at, len(group))))
    again = np.zeros(len(group), bool)
    again[1:] = (group[1:] == group[:-1]) & (text[1:] == text[:-1])
    return again | (rank > first)


def _occur(length: int):
    def occur(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The runs of a batch; of those with equal bytes only the first, the others are known to repeat."""
        for batch in batches:
            bucket, same, text, start, end, rank, d = _sorted_runs(batch, length)
            if not len(bucket):
                continue
            group = paired(bucket.view(np.uint64), same.view(np.uint64))
            order = np.argsort(group, kind="stable")
            again = np.zeros(len(group), bool)
            again[order] = _repeating(group[order], rank[text[order]], text[order])
            yield pd.DataFrame({"key": bucket, "same": pd.array(same, "Int64"), "rank": rank[text], "d": d[text], "at": (start << 32) | end})[~again]
            if again.any():
                some = np.flatnonzero(again)
                some = some[np.lexsort((start[some], text[some]))]
                whose, start, end = joined_parts(text[some], start[some], end[some])
                at = (start << 32) | end
                # a key that spreads these rows over all tasks
                key = paired(at.view(np.uint64), rank[whose].view(np.uint64)).view(np.int64)
                yield pd.DataFrame({"key": key, "same": pd.array([None] * len(at), "Int64"), "rank": rank[whose], "d": d[whose], "at": at})

    return occur


def _content(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the runs whose buckets are to be refined."""
    for batch in batches:
        out: list[tuple] = []
        for rank, d, text, keys, places in batch.itertuples(index=False):
            data = text.encode()
            out += [(key, rank, d, at, data[at >> 32 : at & 0xFFFFFFFF]) for key, at in zip(keys.tolist(), places.tolist())]
        yield pd.DataFrame(out, columns=["key", "rank", "d", "at", "content"])


def _of_windows(rows: pd.DataFrame, length: int) -> tuple[np.ndarray, ...]:
    """row, start and number of each window of the runs."""
    sizes = np.array([len(c) for c in rows["content"]])
    data = np.frombuffer(b"".join(rows["content"]), np.uint8)
    numbers = windows(buckets(data), length)
    row, ends = np.repeat(np.arange(len(rows)), sizes)[: len(numbers)], np.repeat(np.cumsum(sizes), sizes)[: len(numbers)]
    at = np.flatnonzero(np.arange(len(numbers)) + length <= ends)
    start = at + (rows["at"].to_numpy() >> 32)[row[at]] - (np.cumsum(sizes) - sizes)[row[at]]
    return row[at], start, numbers[at]


def _refine(length: int):
    def out(rows: pd.DataFrame) -> pd.DataFrame:
        # equal rows are one document twice
        rows = rows.drop_duplicates(order := ["key", "rank", "d", "at"]).sort_values(order).reset_index(drop=True)
        row, start, number = _of_windows(rows, length)
        rank, d, key = rows["rank"].to_numpy(), rows["d"].to_numpy(), rows["key"].to_numpy()
        text = np.cumsum(np.concatenate(([0], (rank[1:] != rank[:-1]) | (d[1:] != d[:-1]))))
        group = paired(key.view(np.uint64)[row], number)
        order = np.argsort(group, kind="stable")
        some = np.sort(order[_repeating(group[order], rank[row[order]], text[row[order]])])
        at, start, end = joined_parts(row[some], start[some], start[some] + length)
        return pd.DataFrame({"rank": rank[at], "d": d[at], "at": (start << 32) | end})

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None or not len(held) else pd.concat([held, batch], ignore_index=True)
            if not len(held):
                continue
            cut = int(np.argmax(held["key"].to_numpy() == held["key"].iloc[-1]))
            if cut:
                yield out(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield out(held)

    return refine


def _explode(length: int):
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                row, start, number = _of_windows(rows, length)
                yield pd.DataFrame({"key": rows["key"].to_numpy()[row], "number": number.view(np.int64), "rank": rows["rank"].to_numpy()[row], "d": rows["d"].to_numpy()[row], "start": start})

    return explode


def _crowded(rows: DataFrame, length: int) -> DataFrame:
    """The repeating windows of buckets too large for one group."""
    each = rows.mapInPandas(_explode(length), "key long, number long, rank long, d int, start long")
    # the same window twice in a text: its first start there, and whether there are others
    own = each.groupBy("key", "number", "rank", "d").agg(F.collect_set("start").alias("starts"))
    first = own.groupBy("key", "number").agg(F.min("rank").alias("first"))
    again = F.when(F.col("rank") > F.col("first"), F.col("starts")).otherwise(F.filter("starts", lambda s: s > F.array_min("starts")))
    found = own.join(first, ["key", "number"]).select("rank", "d", F.explode(again).alias("start"))
    return found.select("rank", "d", (F.shiftleft("start", 32) + F.col("start") + length).alias("at"))


def _shared(texts: DataFrame, length: int) -> DataFrame:
    """bucket, whether its runs differ, and its first document; of buckets with two runs or more."""
    each = texts.mapInPandas(_count(length), BUCKETS)
    found = each.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"))
    return found.filter("n > 1").select(F.col("bucket").alias("key"), (F.col("low") != F.col("high")).alias("differ"), "first")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """rank, d and parts (start * 2^32 + end, not sorted, some overlapping) of each text that something earlier repeats in.

    `rank` is the doc_id, the least long for null, and `d` a hash of the text, which parts rows of one doc_id."""
    if length < 2 * BUCKET:
        raise ValueError(f"length must be {2 * BUCKET} at least")
    texts = docs.select(*_named())
    spark = docs.sparkSession
    with batches_of(spark, BATCH_BYTES):
        shared = written(_shared(texts, length), "suffix-buckets")
        met = texts.mapInPandas(_occur(length), OCCURRENCES).join(shared, "key", "left")
        again = F.col("same").isNull() | (~F.col("differ") & (F.col("rank") > F.col("first")))
        met = met.withColumn("sure", F.coalesce(again, F.lit(False))).filter("sure or differ")
        met = written(met.select("key", "same", "rank", "d", "at", "sure"), "suffix-runs")
        # runs of equal bytes in buckets whose runs differ: all but those of the first document repeat
        open_ = met.filter("not sure")
        first = open_.groupBy("key", "same").agg(F.min("rank").alias("first"))
        classed = written(open_.join(first, ["key", "same"]).select("key", "rank", "d", "at", (F.col("rank") > F.col("first")).alias("sure")), "suffix-classes")
        wanted = classed.filter("not sure").groupBy("rank", "d").agg(F.collect_set(F.struct("key", "at")).alias("open"))
        content = texts.join(wanted, ["rank", "d"]).select("rank", "d", "text", F.col("open.key").alias("keys"), F.col("open.at").alias("places"))
        content = written(content.mapInPandas(_content, "key long, rank long, d int, at long, content binary"), "suffix-content")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sized = content.join(content.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")
        few = sized.filter(F.col("n") <= PART).drop("n").repartition(n, "key").sortWithinPartitions("key").mapInPandas(_refine(length), "rank long, d int, at long")
        parts = few.unionByName(_crowded(sized.filter(F.col("n") > PART).drop("n"), length))
        for sure in (met, classed):
            parts = parts.unionByName(sure.filter("sure").select("rank", "d", "at"))
        found = written(parts.groupBy("rank", "d").agg(F.collect_list("at").alias("parts")), "suffix-parts")
    return found


def _named():
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rank"), F.hash("text").alias("d"), F.coalesce("text", F.lit("")).alias("text")]


REPORT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<long>"


def _cut(keep: bool):
    def cut(texts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, parts):
            data = (text or "").encode()
            at = np.sort(np.asarray([] if found is None else found, np.int64))
            _, start, end = joined_parts(np.zeros(len(at), np.int64), at >> 32, at & 0xFFFFFFFF)
            edges = [0, *np.column_stack((start, end)).ravel().tolist(), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            spans = ((start << 32) | end).tolist()
            rows.append((len(data), len(data) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept if keep else None, spans))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    cut.__annotations__ = {"texts": pd.Series, "parts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(cut, REPORT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: bool = True) -> DataFrame:
    """The rows of `docs` with `cut`: what was removed (n_bytes, n_removed, n_spans, spans as start * 2^32 + end) and, if
    `keep` says so, the bytes that are kept, with their digest.

    Earlier is what starts in a document with a smaller doc_id, or in the same row before. Null ids come before all
    others; neither of two rows with one doc_id (or null) is earlier than the other. Null texts are empty; texts shorter than `length`
    keep all their bytes. Texts are counted in bytes of UTF-8, and what is kept may break a character."""
    found = repeats(docs, length)
    named = docs.withColumns({"_rank": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_d": F.hash("text")})
    found = found.select(F.col("rank").alias("_rank"), F.col("d").alias("_d"), F.col("parts").alias("_parts"))
    with batches_of(docs.sparkSession, BATCH_BYTES):
        return named.join(found, ["_rank", "_d"], "left").withColumn("cut", _cut(keep)("text", "_parts")).drop("_rank", "_d", "_parts")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    return cut.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256")
