"""Near copies by their text: pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints of the shingles are compared bit by bit under a radius wherever two of them agree in all
bits of some key; inside what that gathers, shingles are counted exactly. Only links that the count confirms
join documents."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Labels, batches_of, components, written
from .simhash import LANES, near_pairs

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: 64-bit words of a fingerprint, all of which keys are drawn from, and how many of them, from the lowest on, are
#: compared. At similarity 0.8 (cosine 0.889) two fingerprints differ in 0.152 of their bits: 39 of the 256 compared.
WORDS, COMPARED = 8, 4
WIDTH = 64 * WORDS
#: Compared bits in which gathered fingerprints differ at most. A pair at 0.8 differs in more with a chance of some
#: 1e-9, an unrelated one in no more with one of some 1e-10.
RADIUS = 76
#: Share of equal bits at similarity 0.8, and the chance that such a pair had no key in common if keys were independent.
#: They share the fingerprint's bits, so there are half as many again: that leaves 6e-7 at 10 bits, 2e-6 at 12, 4e-6 at 14.
AGREEING, MISSED, AGAIN = 0.848, 3e-6, 1.5
#: Sets of so few shingles differ in more bits (four in five: 0.1875), so they have twice as many keys.
FEW = 6
#: Fingerprints that may be expected at one key before keys get longer, and the bits of the shortest and longest keys.
CROWD, SHORTEST, LONGEST = 1 << 11, 10, 24
#: Of a text's keys, the share (one in so many) that is compared first.
FIRST = 8
#: Texts of one key, or gathered ones, that stand together in a part; from two parts on they are compared part by part.
PART = 1 << 11
#: From so many fingerprints at one key on, those that are reached are not compared again.
DENSE = 1 << 8
#: Bytes of text that stand together in a part, and in a batch on its way to Python.
PART_BYTES, BATCH_BYTES = 1 << 22, 1 << 24

_DRAWN = np.random.default_rng(SEED)
_SALTS = _DRAWN.integers(0, 1 << 64, (WORDS, 1), np.uint64)
#: Bits of a fingerprint whose sums are even, at random: if ties all gave 0, sets of two or four would be alike.
_EVEN = _DRAWN.integers(0, 2, WIDTH)
_SHIFTS, _LANES = np.arange(8, dtype=np.uint64)[:, None, None], np.uint64(0x0101010101010101)
_FINGERPRINT = [f"f{i}" for i in range(WORDS)]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles. Fewer words than a shingle: that of all of them; no word: none."""
    digest, last = xxhash.xxh64_intdigest, max(0, len(words) - shingle)
    hashes = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(last + 1)] if words else []
    return np.unique(np.array(hashes, np.uint64))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """A row for each word of a fingerprint: `hashes` mixed with its salt, so that rows are independent."""
    x = hashes ^ _SALTS
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of distinct hashes as `WORDS` words, the lowest first: a bit is 1 if set in over half of them."""
    ones = np.zeros(WIDTH, np.int64)
    # bytes of eight sums at once: up to 255 hashes can't overflow them
    for at in range(0, len(hashes), 255):
        sums = ((_mixed(hashes[at : at + 255]) >> _SHIFTS) & _LANES).sum(axis=2, dtype=np.uint64)
        ones += sums.astype("<u8").view(np.uint8).reshape(8, WIDTH // 8).T.reshape(-1)
    return np.packbits(2 * ones + _EVEN > len(hashes), bitorder="little").view("<u8")


def _signature(text: str | None, shingle: int) -> tuple:
    words = words_of(text)
    hashes = shingles(words, shingle)
    return xxhash.xxh128_digest(b" ".join(words)), len(hashes), *fingerprint(hashes).view(np.int64).tolist()


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and s: digest of the words, number of distinct shingles and the fingerprint's words."""
    names = ["digest", "n", *_FINGERPRINT]

    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_signature(t, shingle) for t in texts], columns=names)

    of.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    schema = ", ".join(["digest binary", "n long", *(f"{f} long" for f in _FINGERPRINT)])
    return docs.select("doc_id", F.pandas_udf(of, schema)("text").alias("s"))


def key_bits(n: int) -> int:
    """As many bits of a key as leave some `CROWD` of n unrelated fingerprints at one."""
    return min(LONGEST, max(SHORTEST, math.ceil(math.log2(max(n, 1) / CROWD))))


def n_keys(bits: int) -> int:
    """Keys of so many bits that a text has: a pair of similarity 0.8 shares each with a chance of `AGREEING` to the power of its bits."""
    return math.ceil(AGAIN * math.log(MISSED) / math.log1p(-(AGREEING**bits)))


def keys_of(fingerprints: np.ndarray, n: np.ndarray, bits: int, most: int | None = None) -> list[np.ndarray]:
    """The keys, or the first `most`, of each fingerprint (a row of words): a key is a fixed choice of bits, its number and their values.

    Sets of up to three shingles are similar only if they are equal: they have one key, a whole word. Those without a
    shingle have none."""
    count, drawn = n_keys(bits), np.random.default_rng(SEED + bits)
    places = np.array([drawn.choice(WIDTH, bits, replace=False) for _ in range(2 * count)])[:most]
    weights = np.int64(1) << np.arange(bits)
    spread = np.unpackbits(np.ascontiguousarray(fingerprints, "<u8").view(np.uint8).reshape(-1, WIDTH // 8), axis=1, bitorder="little")
    found = np.zeros((len(spread), len(places)), np.int64)
    for weight, place in zip(weights, places.T):
        found += spread[:, place] * weight
    found += np.arange(len(places)) << bits
    whole = fingerprints[:, :1].view(np.int64)
    return [w[:m] if m <= 1 else w if m <= 3 else row[: 2 * count if m <= FEW else count] for row, w, m in zip(found, whole, n)]


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """(place, root) for each place that can be reached from an earlier one; `near(i, others)` says which others i links.

    A place that is reached is not compared again, so a dense group costs about one comparison for each."""
    left = np.arange(n)
    while len(left):
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            hit = near(queue.pop(), left)
            reached = left[hit].tolist()
            left = left[~hit]
            queue += reached
            for x in reached:
                yield x, root


def _reaching(values: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    words = np.ascontiguousarray(values.T)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        differing = np.zeros(len(others), np.uint16)
        for word in words:
            differing += np.bitwise_count(word[others] ^ word[i])
        return differing <= RADIUS

    return near


def near_fingerprints(values: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of places that join all fingerprints of one group which can be reached within `RADIUS`. Groups stand together."""
    _, first, which, size = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
    loose = np.flatnonzero(size[which] < DENSE)
    for i, j in near_pairs(values[loose], group[loose], RADIUS):
        yield loose[i], loose[j]
    for a, n in zip(first[size >= DENSE], size[size >= DENSE]):
        found = np.array(list(forest(n, _reaching(values[a : a + n]))), np.int64).reshape(-1, 2)
        yield a + found[:, 0], a + found[:, 1]


def text_forest(texts: list[str | None], shingle: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Links by the exact similarity of shingles; texts without any word are alike."""
    sets = [shingles(words_of(t), shingle) for t in texts]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    known, member = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, np.int64))
    ends = np.cumsum(size)
    seen = np.zeros(len(known) + 1, bool)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        alike = np.minimum(size[i], size[others]) >= similarity * np.maximum(size[i], size[others]) - 1e-9
        some = others[alike]
        mine = member[ends[i] - size[i] : ends[i]]
        seen[mine] = True
        # the running count of shared members, at the ends of each of the others
        begin = np.cumsum(size[some]) - size[some]
        places = np.repeat(ends[some] - size[some] - begin, size[some]) + np.arange(int(size[some].sum()))
        shared = np.concatenate(([0], np.cumsum(seen[member[places]])))
        both = shared[begin + size[some]] - shared[begin]
        seen[mine] = False
        alike[alike] = both >= similarity * (size[i] + size[some] - both) - 1e-9
        return alike

    return forest(len(sets), near)


def near_texts(shingle: int, similarity: float):
    """Places that join the texts of each group, as `near_fingerprints` does fingerprints."""

    def near(values: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)]):
            if b - a > 1:
                found = np.array(list(text_forest(values[a:b].tolist(), shingle, similarity)), np.int64).reshape(-1, 2)
                yield a + found[:, 0], a + found[:, 1]

    return near


def _stars(id_: str, value: list[str], links: Callable[[np.ndarray, np.ndarray], Iterator], lanes: int):
    """Edges (a, b) of each group of rows with equal (key, part_a, part_b), which stand together; some `lanes` rows are worked off at once."""
    group_by = ["key", "part_a", "part_b"]

    def out(rows: pd.DataFrame) -> pd.DataFrame:
        keys, ids = rows[group_by].to_numpy(), rows[id_].to_numpy()
        begin = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        # a group of one id has nothing to join
        several = np.repeat(np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin), np.diff(begin, append=len(ids)))
        rows, keys, ids = rows[several], keys[several], ids[several]
        if not len(rows):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        group = np.cumsum(np.append(False, (keys[1:] != keys[:-1]).any(axis=1)))
        labels = Labels(len(rows))
        values = rows[value[0]].to_numpy() if len(value) == 1 else rows[value].to_numpy().view(np.uint64)
        for i, j in links(values, group):
            labels.join(i, j)
        # to the smallest id, so that the same rows in other groups give the same edges
        least = ids.copy()
        np.minimum.at(least, labels.label, ids)
        edges = pd.DataFrame({"a": ids, "b": least[labels.label]}, dtype="int64")
        return edges[edges["a"] != edges["b"]].drop_duplicates()

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) >= lanes:
                rows = pd.concat(held, ignore_index=True)
                keys = rows[group_by].to_numpy()
                cut = int(np.argmax((keys == keys[-1]).all(axis=1)))
                if cut:
                    yield out(rows.iloc[:cut])
                held = [rows.iloc[cut:]]
        if held:
            yield out(pd.concat(held, ignore_index=True))

    return stars


def _compared(dealt: DataFrame, id_: str, value: list[str], links, lanes: int) -> DataFrame:
    n, order = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["key", "part_a", "part_b"]
    return dealt.repartition(n, *order).sortWithinPartitions(*order).mapInPandas(_stars(id_, value, links, lanes), "a long, b long")


def _weight(size: Column | None = None) -> Column:
    """What a row takes of a part, of which there are `PART_BYTES`."""
    return (F.lit(PART_BYTES // PART) + (0 if size is None else F.coalesce(size, F.lit(0)))).cast("long").alias("w")


def _parts(size: Column) -> Column:
    return F.ceil(size / PART_BYTES).cast("int")


def _crowded(rows: DataFrame, tag: str) -> DataFrame:
    """(key, parts) of the keys of `rows` (key, w) that fill more than two parts.

    They are few, or none: as files they have a size that Spark knows, so that rows need not be shuffled to meet them."""
    sizes = rows.groupBy("key").agg(F.sum("w").alias("size")).filter(F.col("size") > 2 * PART_BYTES)
    return written(sizes.select("key", _parts(F.col("size")).alias("parts")), tag)


def _alone(rows: DataFrame, crowded: DataFrame, id_: str, value: list[str], links, lanes: int = 1) -> DataFrame:
    """Edges of `rows` (key, id, values) that stand in one part of a key: nothing of a crowded key meets all of its parts.

    A crowded key is cut twice, by independent hashes, so that the parts of a dense group are joined through each other."""
    place = lambda cut: F.struct(F.pmod(F.xxhash64(F.lit(cut), "key", id_, *value), F.col("parts")).cast("int").alias("part_a"), F.lit(cut).alias("part_b"))
    whole = F.struct(F.lit(0).alias("part_a"), F.lit(0).alias("part_b"))
    places = F.when(F.col("parts").isNull(), F.array(whole)).otherwise(F.array(place(0), place(1)))
    dealt = rows.join(crowded, "key", "left").select("key", id_, *value, F.explode(places).alias("t"))
    return _compared(dealt.select("key", "t.part_a", "t.part_b", id_, *value), id_, value, links, lanes)


def _across(rows: DataFrame, crowded: DataFrame, id_: str, value: list[str], links, tag: str, lanes: int = 1) -> DataFrame:
    """Edges between the labels of `rows` (key, id, label, w, values), which join all that is linked in any key.

    What has one label is joined already, so in a crowded key the rows of its largest label need not meet each
    other, only the rest, part by part; parts of the rest meet each other too. One dense group of any size, with
    up to a part of others, thus goes to its key once, and each of those others once for each of its parts."""
    by_label = rows.join(crowded.select("key"), "key").groupBy("key", "label").agg(F.sum("w").alias("size"))
    largest = by_label.groupBy("key").agg(F.max_by("label", "size").alias("main"), F.max("size").alias("size"), F.sum("size").alias("all"))
    cut = written(largest.select("key", "main", _parts(F.col("size")).alias("p"), _parts(F.col("all") - F.col("size")).alias("q")), tag)
    # a key that isn't crowded has one part, as if it were all main and met an empty rest
    p, q, main = F.coalesce("p", F.lit(1)), F.coalesce("q", F.lit(1)), F.coalesce(F.col("label") == F.col("main"), F.lit(True))
    own = F.xxhash64("key", id_, *value)
    i, j = F.pmod(own, p).cast("int"), F.pmod(own, F.greatest(q, F.lit(1))).cast("int")

    def meet(n: Column, a, b) -> Column:
        each = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda o: o < n)
        return F.transform(each, lambda o: F.struct(a(o).cast("int").alias("part_a"), b(o).cast("int").alias("part_b")))

    rest = F.filter(meet(q, lambda o: -1 - F.least(o, j), lambda o: F.greatest(o, j)), lambda t: -1 - t["part_a"] != t["part_b"])
    met = F.when(main, meet(q, lambda o: i, lambda o: o)).otherwise(F.concat(meet(p, lambda o: o, lambda o: j), rest))
    dealt = rows.join(cut, "key", "left").select("key", "label", *value, F.explode(met).alias("t"))
    return _compared(dealt.select("key", "t.part_a", "t.part_b", "label", *value), "label", value, links, lanes)


def _labelled(rows: DataFrame, id_: str, found: DataFrame) -> DataFrame:
    """`rows` with the component of their id as label; an id without one is its own."""
    labels = found.select(F.col("node").alias(id_), F.col("component").alias("label"))
    return rows.join(labels, id_, "left").withColumn("label", F.coalesce("label", id_))


def gathered(classes: DataFrame) -> DataFrame:
    """(node, component) of the classes (cid, s) whose fingerprint is near some other's: what is near is in one component.

    A dense group is near itself at most keys. The first few join it, so that the others give edges between
    what isn't joined yet, not a star of the group for each key."""
    bits, compared = key_bits(classes.count()), _FINGERPRINT[:COMPARED]

    def keyed(some: DataFrame, most: int | None, *more: str) -> DataFrame:
        def of(s: pd.DataFrame) -> pd.Series:
            return pd.Series(keys_of(s[_FINGERPRINT].to_numpy().view(np.uint64), s["n"].to_numpy(), bits, most))

        of.__annotations__ = {"s": pd.DataFrame, "return": pd.Series}
        return some.select("cid", *more, *(F.col(f"s.{f}") for f in compared), F.explode(F.pandas_udf(of, "array<long>")("s")).alias("key"), _weight())

    first = keyed(classes, -(-n_keys(bits) // FIRST))
    found = components(_alone(first, _crowded(first, "near-text-crowded"), "cid", compared, near_fingerprints, LANES), "near-text-first")
    rows = keyed(written(_labelled(classes, "cid", found), "near-text-labelled"), None, "label")
    edges = _across(rows, _crowded(rows, "near-text-crowded"), "cid", compared, near_fingerprints, "near-text-cut", LANES)
    return components(edges.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))), "near-text-gathered")


def text_edges(docs: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges (a, b) between documents, one of each class (rep, cid), whose texts have the similarity."""
    found = gathered(classes)
    members = found.join(classes, F.col("node") == F.col("cid")).select(F.col("component").alias("key"), F.col("rep").alias("doc_id")).distinct()
    rows = docs.select("doc_id", "text").join(members, "doc_id").distinct()
    rows = written(rows, "near-text-members").withColumn("w", _weight(F.octet_length("text")))
    crowded, links = _crowded(rows, "near-text-crowded"), near_texts(shingle, similarity)
    edges = _alone(rows, crowded, "doc_id", ["text"], links)
    if crowded.isEmpty():
        return edges
    edges = written(edges, "near-text-alone")
    parted = _labelled(rows.join(crowded.select("key"), "key", "left_semi"), "doc_id", components(edges, "near-text-parts"))
    return edges.unionByName(_across(parted, crowded, "doc_id", ["text"], links, "near-text-cut"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of each document whose component has a smaller doc_id, which is component_id.

    Texts of equal words form a class, which is compared once; texts without words are one. Rows of one
    doc_id are one document and link what any of them links. Rows without a doc_id link nothing."""
    with batches_of(docs.sparkSession, BATCH_BYTES):
        found = written(signatures(docs.filter("doc_id is not null"), shingle), "near-text")
        classes = found.groupBy(F.col("s.digest").alias("digest")).agg(F.min("doc_id").alias("rep"), F.first("s").alias("s"))
        classes = written(classes.withColumn("cid", F.xxhash64("digest")), "near-text-classes")
        edges = text_edges(docs, classes, shingle, similarity)
        copies = found.select("doc_id", "s.digest").join(classes.select("digest", "rep"), "digest").filter("doc_id <> rep")
        reached = components(edges.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), "near-text-components")
    return reached.filter("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def drop_near_text(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its group, with all their columns.

    Rows without a doc_id stay."""
    return docs.join(near_groups(docs, shingle, similarity).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
