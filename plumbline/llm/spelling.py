"""Spelling variants: words that differ by one character, found by Aho-Corasick over the halves of all words.

One edit leaves one half of a word whole, the first at the other word's start or the second at its end. Words are
dealt by their first and by their last three characters to shards; a shard's automaton holds the halves of its
words that begin or end so, and all words that do are run through it. A hit at the right end of a word whose length is
compatible is a candidate, and what is left of both words is compared. Each shard tells of a word how many near
ones it has and which is the most frequent, so pairs are never written out."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, OCCURRENCES, TIMES, SLIP = 6, 5, 5, 199
#: Characters at a word's ends that shards go by; a half has as many at least.
END = LEAST // 2
#: Words of a shard. Words that share an end and are more are dealt to several automata, each of which reads all of them.
PART = 1 << 13
#: Differences of characters held at once, and pairs of words below which they are compared one by one.
STEP, FEW = 1 << 20, 6


def words(docs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES, slip: int = SLIP) -> DataFrame:
    """(word, n) of `docs` (doc_id, text): runs of letters with A-Z lower-cased, of which some lose a character.

    A run whose crc32 with its document's id (the empty text for null) is divided by `slip` loses one. Words of
    `least` characters that come `occurrences` times are returned. Null texts have none."""
    # a run is a word's length or one more, so shorter ones needn't be looked at
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({RUN}{{{least},}})"), F.lit(1))).alias("run")
    runs = docs.select("doc_id", run)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    found = runs.select(F.when(h % slip == 0, slipped).otherwise(F.col("run")).alias("word"))
    return found.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


def halves(word: str) -> tuple[str, str]:
    return word[: len(word) // 2], word[len(word) // 2 :]


def one_edit(a: str, b: str) -> bool:
    """Do they differ by exactly one inserted, deleted or replaced character?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _matrix(rests: list[str]) -> np.ndarray:
    return np.frombuffer("".join(rests).encode("utf-32-le"), np.uint32).reshape(len(rests), -1)


def _run_of(equal: np.ndarray) -> np.ndarray:
    """How many are true before the first false along the last axis."""
    return np.logical_and.accumulate(equal, axis=-1).sum(axis=-1)


def near_rests(read: list[str], held: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs (of `read`, of `held`) that differ by one edit; those of either list are equally long."""
    if len(read) * len(held) <= FEW:
        yield from ((i, j) for i, a in enumerate(read) for j, b in enumerate(held) if one_edit(a, b))
        return
    a, b = _matrix(read), _matrix(held)
    step = max(1, STEP // (b.size + len(b)))
    for at in range(0, len(a), step):
        x, y = a[at : at + step, None], b[None]
        if a.shape[1] == b.shape[1]:
            near = (x != y).sum(axis=-1) == 1
        else:
            less, more = (x, y) if a.shape[1] < b.shape[1] else (y, x)
            near = _run_of(less == more[..., :-1]) + _run_of((less == more[..., 1:])[..., ::-1]) >= less.shape[-1]
        for i, j in zip(*(k.tolist() for k in np.nonzero(near))):
            yield at + i, j


def near_in(rows: pd.DataFrame) -> pd.DataFrame:
    """word, n_near, form and form_n for the words of a shard (word, n, side, held) that have near ones in it."""
    texts, side, n = rows["word"].tolist(), rows["side"].to_numpy(), rows["n"].to_numpy()
    automaton, at = ahocorasick.Automaton(), {}
    # of each segment and side, the words that have it, by length
    having: list[tuple[dict, dict]] = []
    for i in np.flatnonzero(rows["held"].to_numpy()).tolist():
        segment = halves(texts[i])[side[i]]
        if segment not in at:
            at[segment] = len(having)
            having.append((defaultdict(list), defaultdict(list)))
            automaton.add_word(segment, (len(segment), at[segment]))
        having[at[segment]][side[i]][len(texts[i])].append(i)
    columns = ["word", "n_near", "form", "form_n"]
    if not having:
        return pd.DataFrame([], columns=columns)
    automaton.make_automaton()
    read: dict[tuple[int, int, int], list[int]] = defaultdict(list)
    for i, (text, s) in enumerate(zip(texts, side.tolist())):
        for end, (size, segment) in automaton.iter(text):
            if (end == len(text) - 1) if s else (end == size - 1):
                if having[segment][s]:
                    read[segment, s, len(text)].append(i)
    order = sorted(range(len(texts)), key=lambda i: (-n[i], texts[i]))
    place = np.empty(len(texts), np.int64)
    place[order] = np.arange(len(texts))
    count, best = np.zeros(len(texts), np.int64), np.full(len(texts), len(texts))
    for (segment, s, length), mine in read.items():
        for other in (length - 1, length, length + 1):
            held = having[segment][s].get(other)
            if not held:
                continue
            size = other // 2 if s == 0 else other - other // 2
            rest = (lambda t: t[:-size]) if s else (lambda t: t[size:])
            for i, j in near_rests([rest(texts[i]) for i in mine], [rest(texts[j]) for j in held]):
                i, j = mine[i], held[j]
                # what both halves find counts once, by the first
                if not (s and texts[i].startswith(halves(texts[j])[0])):
                    count[i] += 1
                    best[i] = min(best[i], place[j])
    return pd.DataFrame([(texts[i], count[i], texts[order[best[i]]], n[order[best[i]]]) for i in np.flatnonzero(count).tolist()], columns=columns)


def near_words(found: DataFrame) -> DataFrame:
    """word, n_near, form and form_n of the words (word, n) that have near ones; form is the most frequent, the smallest of equals."""
    ends = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), e.alias("end")) for s, e in enumerate((F.substring("word", 1, END), F.right("word", F.lit(END))))]))
    rows = written(found.select("word", "n", ends.alias("e")).select("word", "n", "e.*"), "spelling-ends")
    # how many words an end has: a table no larger than the triples of letters
    sizes = rows.groupBy("side", "end").agg(F.count("*").alias("size"))
    total = rows.count()
    parts = F.ceil(F.col("size") / PART).cast("int")
    own = F.pmod(F.xxhash64("word"), parts).cast("int")
    dealt = rows.join(sizes, ["side", "end"]).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    few = F.pmod(F.hash("side", "end"), F.lit(max(1, total // PART))).cast("string")
    shard = F.when(parts == 1, few).otherwise(F.concat_ws(":", "side", "end", "part"))
    dealt = dealt.select("word", "n", "side", (F.col("part") == own).alias("held"), shard.alias("shard"))
    each = dealt.groupBy("shard").applyInPandas(near_in, "word string, n_near long, form string, form_n long")
    least = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame, times: int, most: int) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last. Each form is `times` as frequent as its word, the
    most frequent one `most`, so that paths are short and a join that doubles what was followed ends soon."""
    found, longest, done = forms.select("word", F.col("form").alias("root")), 1, 1
    while times**longest < most:
        longest += 1
    while done < longest:
        found = written(found, "spelling-roots")
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found, done = found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), 2 * done
    return found


def variants(docs: DataFrame, times: int = TIMES, **how) -> DataFrame:
    """word, n, n_near, form, form_n and root of the words of `docs`; `how` goes to `words`.

    A form is the near word with the largest n, if that is `times` the word's own at least, and null otherwise; `root` is
    where forms lead, the word itself if it has none. Documents without a text have no words; no words: no rows."""
    found = written(words(docs, **how), "spelling-words")
    near = near_words(found)
    joined = found.join(near, "word", "left")
    formed = F.col("form_n") >= times * F.col("n")
    joined = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(formed, F.col(c)).alias(c) for c in ("form", "form_n")]), "spelling-near")
    most = joined.agg(F.max("n")).first()[0] or 0
    led = roots(joined.filter("form is not null").select("word", "form"), times, most)
    return joined.join(led, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
