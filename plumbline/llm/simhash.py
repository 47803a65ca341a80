"""SimHash near-duplicates: fingerprints, a bit-sliced comparison under a radius, and their components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Labels, components, table, written

WIDTH = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of one block value that a task compares at once; larger groups are compared part by part.
PART = 1 << 14
#: Fingerprints that may be expected at one value before keys get longer.
CROWD = 256
#: Fingerprints that stand in one array of bit planes.
LANES = 1 << 15
#: Words of places that are compared at once.
STEP = 1 << 13


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer. No word: zero. Fewer words than a shingle: that of all of them."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, last = b" ".join(words), max(0, len(words) - shingle)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[: last + 1].tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(begins, ends[min(shingle, len(words)) - 1 :].tolist())], np.uint64)
    ones = np.zeros(WIDTH, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and its fingerprint's bits as a signed long."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    of.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return docs.select("doc_id", F.pandas_udf(of, "long")("text").alias("fp"))


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of every value, 64 values to a word, the first lowest.

    Values of more than 64 bits are rows of words, the lowest first."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")
    bits = np.pad(bits, ((0, -len(values) % 64), (0, 0)))
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _within(some: np.ndarray, word: np.ndarray, by: np.ndarray, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i and steps for which the values at i and i + step differ in `radius` bits at most.

    Each of the arrays `word`, `by` and `wanted` has one entry for a word of 64 places, the step at which
    it is compared and the set of its places that count. Differences are counted for all 64 at once: a
    carry-save adder takes the planes seven at a time, its counters stand vertically, and a word is given
    up once all its places exceed the radius."""
    over = ~wanted
    n_counters = max(3, (radius + 8).bit_length())
    counters = [np.zeros(len(word), np.uint64) for _ in range(n_counters)]
    far, bit = word + by // 64, (by % 64).astype(np.uint64)
    # planes end in two words of zeros: a shift by 64 - 0 bits takes its word from there
    far_next, rest = np.where(bit == 0, some.shape[1] - 1, far + 1), (np.uint64(64) - bit) % np.uint64(64)
    for b in range(0, len(some), 7):
        seven = [plane[word] ^ ((plane[far] >> bit) | (plane[far_next] << rest)) for plane in some[b : b + 7]]
        # 7:3 adder: ones, twos and fours of up to seven differences
        zero = np.zeros(len(word), np.uint64)
        seven += [zero] * (7 - len(seven))
        s1, c1 = _full(*seven[:3])
        s2, c2 = _full(*seven[3:6])
        ones, c3 = _full(s1, s2, seven[6])
        twos, fours = _full(c1, c2, c3)
        carry = zero
        for k, add in enumerate((ones, twos, fours)):
            counters[k], carry = _full(counters[k], add, carry)
        for k in range(3, n_counters):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        # what has overflowed once stays over; its counters need no meaning
        over |= carry | _exceeds(counters, radius)
        keep = over != ~np.uint64(0)
        if np.count_nonzero(keep) < 0.8 * len(keep):
            word, by, far, far_next, bit, rest, over = (x[keep] for x in (word, by, far, far_next, bit, rest, over))
            counters = [c[keep] for c in counters]
        if not len(word):
            break
    rows, bits = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64))
    return word[rows] * 64 + bits, by[rows]


def _full(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Places whose vertical counter is over `radius`."""
    more, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ~np.uint64(0))
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            more, equal = more | (equal & counters[k]), equal & ~counters[k]
    return more


def near_pairs(values: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of places (i, j), i < j, of one group and within `radius`. Groups stand together in `group`.

    A value is an integer of 64 bits or a row of such words.

    Every value is compared with those 1, 2, 3, ... places later. Groups leave the planes once the step
    is as large as they are."""
    place, by = np.arange(len(values)), 1
    while len(values) > by:
        _, which, size = np.unique(group, return_inverse=True, return_counts=True)
        large = size[which] > by
        values, group, place = values[large], group[large], place[large]
        if not len(values):
            return
        some = np.pad(planes(values), ((0, 0), (0, 2)))
        words, until = some.shape[1] - 2, min(2 * by, len(values))
        while by < until:
            some_by = np.arange(by, min(until, by + max(1, STEP // words)))
            same = np.zeros((len(some_by), words * 64), np.uint8)
            for row, step in zip(same, some_by):
                row[: len(values) - step] = group[:-step] == group[step:]
            wanted = np.packbits(same, axis=1, bitorder="little").view("<u8")
            row, word = np.nonzero(wanted)
            at, step = _within(some, word, some_by[row], wanted[row, word], radius)
            if len(at):
                yield place[at], place[at + step]
            by = int(some_by[-1]) + 1


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each of the blocks that share the width."""
    cuts = [round(WIDTH * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _compare(radius: int):
    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def out(rows: pd.DataFrame) -> pd.DataFrame:
            keys = rows[["block", "value", "part_a", "part_b"]].to_numpy()
            group = np.cumsum(np.append(False, (keys[1:] != keys[:-1]).any(axis=1)))
            reps, labels = rows["rep"].to_numpy(), Labels(len(rows))
            for i, j in near_pairs(rows["fp"].to_numpy().view(np.uint64), group, radius):
                labels.join(i, j)
            a, b = labels.stars()
            return pd.DataFrame({"a": reps[a], "b": reps[b]})

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= LANES:
                rows = pd.concat(held, ignore_index=True)
                last = (rows[["block", "value", "part_a", "part_b"]] == rows[["block", "value", "part_a", "part_b"]].iloc[-1]).all(axis=1).to_numpy()
                cut = int(np.argmax(last))
                if cut:
                    yield out(rows.iloc[:cut])
                held = [rows.iloc[cut:]]
        if held:
            yield out(pd.concat(held, ignore_index=True))

    return stars


def choose_blocks(n: int, radius: int) -> int:
    """As many blocks as leave some `CROWD` of n random fingerprints at one value: more blocks, more and longer keys."""
    for blocks in range(radius + 1, radius + 5):
        bits = sum(sorted(size for _, size in block_bounds(blocks))[: blocks - radius])
        if n >> bits <= CROWD:
            break
    return blocks


def near_edges(classes: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) that join any two of `classes` (fp, rep) within `radius`: not all pairs, but a forest of each task's.

    Two fingerprints that differ in `radius` bits at most agree in all but `radius` of the blocks. Each goes
    to its value of every choice of that many blocks, where all are compared. Any number of blocks over
    `radius` gives the same groups; by default it follows the number of fingerprints, so that values stay
    selective. A value with more than `PART` fingerprints is cut into parts by their hash; every two parts
    meet in a task of their own."""
    bounds = block_bounds(blocks or choose_blocks(classes.count(), radius))
    keys = []
    for i, chosen in enumerate(combinations(bounds, len(bounds) - radius)):
        value, shift = F.lit(0).cast("long"), 0
        for low, n in chosen:
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", low).bitwiseAND((1 << n) - 1), shift))
            shift += n
        keys.append(F.struct(F.lit(i).alias("block"), value.alias("value")))
    rows = classes.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("fp", "rep", "k.block", "k.value")
    crowded = rows.groupBy("block", "value").count().filter(F.col("count") > PART)
    crowded = crowded.select("block", "value", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(own, o).alias("part_a"), F.greatest(own, o).alias("part_b"))
    )
    met = F.filter(met, lambda p: (p["part_a"] != p["part_b"]) | (F.col("parts") == 1))
    dealt = (
        rows.join(crowded, ["block", "value"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .select("fp", "rep", "block", "value", F.explode(met).alias("p"))
        .select("fp", "rep", "block", "value", "p.part_a", "p.part_b")
    )
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["block", "value", "part_a", "part_b"]
    return dealt.repartition(n, *order).sortWithinPartitions(*order).mapInPandas(_compare(radius), "a long, b long")


def group_near(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id reachable over links.

    One row for each row of `docs` (doc_id, text). Texts without words, null ones too, share fingerprint
    zero and are linked like any other. Rows with equal fingerprints form a class, which is compared
    once. Rows of one doc_id are one document and link what any of them links. A null doc_id gets its
    fingerprint, but no component, and links nothing."""
    found = written(fingerprints(docs, shingle), "simhash")
    classes = found.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "simhash-classes")
    edges = near_edges(classes, radius)
    # a doc_id on rows of different texts joins their classes
    same = found.join(classes, "fp").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    twice = found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y")
    edges = edges.unionByName(same.join(twice.select(F.col("doc_id").alias("a")), "a", "left_semi"))
    reached = components(edges, "simhash-components")
    classes = classes.join(reached, classes["rep"] == reached["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return found.join(classes, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def drop_near(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its group, with all their columns.

    Rows without a doc_id stay."""
    groups = group_near(docs, shingle, radius).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_near(table(spark, sf_dir, "documents"))
