"""Benchmark decontamination: winnowed k-gram fingerprints, then each hit extended to the windows around it."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remembering, table, written

SPAN = 13
GRAM = 8
#: Consecutive k-grams of which the least is kept: any shared SPAN words then share a fingerprint.
WINNOW = SPAN - GRAM + 1
#: Bytes of distinct benchmark texts and their ids in one index that all tasks hold; a larger benchmark is worked
#: off in slices. An index takes some seven times its texts: their words, where each begins, fingerprints, windows.
SLICE = 8 << 20
REMEMBERED = 200_000

# A-Z become lower case, other ASCII characters but digits and a-z become spaces.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)

FOUND = "n_words long, spans array<int>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORDS).split() if text else []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    forget = dict.clear


_HASHES = _Hashes()


def gram_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words."""
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= ODD
        out += h[j : j + n]
    out ^= out >> np.uint64(29)
    out *= ODD
    return out


def least_grams(hashes: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """The fingerprint of each span: the least hash of `window` consecutive grams."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    least = hashes[:n].copy()
    for j in range(1, window):
        np.minimum(least, hashes[j : j + n], out=least)
    return least


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of `wanted` is in the sorted `keys`, and whether it is."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Windows:
    """The distinct windows of one length: sorted hashes, a word at which each begins, and the items that have it."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        hashes, item, word = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((word, item, hashes))
        hashes, item, word = hashes[order], item[order], word[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        fresh = new | np.concatenate(([True], item[1:] != item[:-1]))
        self.hashes, self.word, self.items = hashes[new], word[new], item[fresh]
        self.first = np.append(np.flatnonzero(new[fresh]), len(self.items))

    def size(self) -> int:
        return self.hashes.nbytes + self.word.nbytes + self.items.nbytes + self.first.nbytes


class Index:
    """Fingerprints and windows of some benchmark texts: spans of long texts, the whole of short ones.

    All words stand one after the other in one string, with an array of where each begins. A window that comes
    again and again, in one item or in many, is there once, so repeated words cost no more than others."""

    def __init__(self, items: list[tuple[list[str], str | None]]) -> None:
        self.ids: list[list[str]] = []
        texts, lengths, words_before = [], [], 0
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        least = [np.zeros(0, np.uint64)]
        for ids, text in items:
            if not (words := words_of(text)):
                continue
            k = min(SPAN, len(words))
            hashes = gram_hashes(words, k)
            parts[k].append((hashes, np.full(len(hashes), len(self.ids), np.int32), words_before + np.arange(len(hashes))))
            if k == SPAN:
                least.append(np.unique(least_grams(gram_hashes(words, GRAM))))
            self.ids.append(sorted(i for i in ids if i is not None))
            texts.append(b" ".join(words))
            words_before += len(words)
            lengths.append(np.fromiter(map(len, words), np.int32, len(words)))
        self.blob = b" ".join(texts)
        # a space is between any two words
        self.begins = np.concatenate(([0], np.cumsum(np.concatenate(lengths) + 1, dtype=np.int64))) if lengths else np.zeros(1, np.int64)
        self.fingerprints = np.unique(np.concatenate(least))
        self.tables = {k: Windows(p) for k, p in parts.items()}

    def size(self) -> int:
        """Bytes of its arrays and words."""
        return len(self.blob) + self.begins.nbytes + self.fingerprints.nbytes + sum(t.size() for t in self.tables.values())

    def _starts(self, words: list[bytes], k: int, table: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of `table` begin in the words, and which they are.

        A span is looked at only if its fingerprint is one of the benchmark's."""
        at = np.arange(len(words) - k + 1)
        if k == SPAN:
            at = at[_found(self.fingerprints, least_grams(gram_hashes(words, GRAM)))[1]]
            if not len(at):
                return at, at
        which, there = _found(table.hashes, gram_hashes(words, k)[at])
        at, which = at[there], which[there]
        # each distinct window is compared word by word where it comes first
        distinct, first = np.unique(which, return_index=True)
        begin = self.begins[table.word[distinct]].tolist()
        end = (self.begins[table.word[distinct] + k] - 1).tolist()
        same = np.array([b" ".join(words[p : p + k]) == self.blob[a:b] for p, a, b in zip(at[first].tolist(), begin, end)], bool)
        kept = np.isin(which, distinct[same])
        return at[kept], which[kept]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The spans of words (start, end) that are in an occurring window, and the items that have one."""
        spans, items = [], set()
        for k, table in self.tables.items():
            if len(words) < k:
                continue
            at, which = self._starts(words, k, table)
            if not len(at):
                continue
            cut = np.flatnonzero(np.diff(at) > k)
            spans += zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + k).tolist())
            which = np.unique(which)
            for i in np.unique(np.concatenate([table.items[a:b] for a, b in zip(table.first[which], table.first[which + 1])])).tolist():
                items.update(self.ids[i])
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(index):
    def found(texts: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
        remembering(_HASHES)
        rows = []
        for text, old_spans, old_items in zip(texts, spans, items):
            words = words_of(text)
            new_spans, new_items = index.value.find(words) if words else ([], set())
            old = np.asarray(old_spans, np.int64).reshape(-1, 2).tolist()
            all_spans = merged([*map(tuple, old), *new_spans])
            rows.append((len(words), [x for s in all_spans for x in s], sorted({*old_items, *new_items})))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    found.__annotations__ = {"texts": pd.Series, "spans": pd.Series, "items": pd.Series, "return": pd.DataFrame}
    return found


def search(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """`docs` with a column `found`: number of words, hit spans of words (start, end, ...) and items, as text.

    Texts of the benchmark (item_id, text) are made distinct, each with its ids, and measured. An index of
    one slice, of `slice_bytes` or about that, is sent to all tasks; a benchmark of more is cut by the hash
    of its texts, and documents meet one slice after another, with what was found so far written in
    between. Null texts have no words. Items without words have no windows. Rows of one item_id are texts
    of one item; an item without an id hits words but can't be named."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string"), "text").filter("text is not null").groupBy("text").agg(F.collect_set("item_id").alias("ids"))
    items = written(items.select("ids", "text"), "decontam-items")
    ids = F.aggregate("ids", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x))
    size = items.agg(F.sum(F.octet_length("text") + ids)).first()[0] or 0
    slices = max(1, math.ceil(size / slice_bytes))
    out = docs.withColumn("found", F.lit(None).cast(f"struct<{', '.join(':'.join(c.split()) for c in FOUND.split(', '))}>"))
    nothing = F.array().cast("array<int>"), F.array().cast("array<string>")
    for k in range(slices):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(slices)) == k).collect() if slices > 1 else items.collect()
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in part]))
        old = nothing if not k else (F.col("found.spans"), F.col("found.items"))
        out = out.withColumn("found", F.pandas_udf(_search(index), FOUND)("text", *old))
        if k < slices - 1:
            out = written(out, "decontam")
    return out


def contaminated(n_words, n_hit):
    """A twentieth of the words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def hit_words(spans):
    """Words in spans that are told as start, end, start, end, ..."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda n, x: n + x)


def report(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): counts, digest of the items found, and the verdict."""
    rows = search(docs.select("doc_id", "text"), benchmark, slice_bytes).select("doc_id", "found.*")
    rows = rows.withColumn("n_hit", hit_words(F.col("spans")))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their columns."""
    rows = search(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), benchmark, slice_bytes)
    kept = rows.filter(~contaminated(F.col("found.n_words"), hit_words(F.col("found.spans"))))
    return kept.select("row.*")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
