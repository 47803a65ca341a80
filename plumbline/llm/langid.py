"""Language identification by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

DIMENSIONS = 1024
SEED = 20
#: Letters are told apart in so many classes: 0 parts words, a-z have their own, others share the rest by code point.
CLASSES = 64
GRAM = 3
UNKNOWN = "und"
#: Characters of a text that are looked at together; whole texts are read, piece by piece.
PIECE = 1 << 20


def letter_vectors(dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """A random vector of +1 and -1 for each class, rolled by 2, 1 and 0 places: one for each place in a trigram."""
    base = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (CLASSES, dimensions))
    return np.stack([np.roll(base, GRAM - 1 - place, axis=1) for place in range(GRAM)])


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The bound (multiplied) vectors of trigram numbers."""
    return letters[0][grams // CLASSES**2] * letters[1][grams // CLASSES % CLASSES] * letters[2][grams % CLASSES]


def _class(code: int) -> int:
    if not chr(code).isalpha():
        return 0
    low = chr(code).lower()[0]
    return ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (CLASSES - 27)


def _classes() -> np.ndarray:
    """The class of each code point of the basic plane; the last of them, no letter, stands in for all beyond."""
    return np.fromiter(map(_class, range(1 << 16)), np.uint8, 1 << 16)


_CLASSES: list[np.ndarray] = []


def count_grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Trigram numbers and how often each occurs; None where there is no letter.

    Runs of other characters count as one that parts words; a text begins and ends with one."""
    if not text:
        return None
    if not _CLASSES:
        _CLASSES.append(_classes())
    found: dict[int, int] = {}
    parts, any_letter = [], False
    carry = np.zeros(1, np.int64)
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].encode("utf-32-le"), np.uint32)
        kinds = _CLASSES[0][np.minimum(codes, 0xFFFF)].astype(np.int64)
        for code in np.unique(codes[codes > 0xFFFF]).tolist():
            kinds[codes == code] = _class(code)
        any_letter |= bool(kinds.any())
        kinds = np.concatenate((carry, kinds, [0] if at + PIECE >= len(text) else []))
        kept = kinds[np.concatenate(([True], (kinds[1:] != 0) | (kinds[:-1] != 0)))].astype(np.int64)
        parts.append(np.unique((kept[:-2] * CLASSES + kept[1:-1]) * CLASSES + kept[2:], return_counts=True))
        carry = kept[-2:]
    if not any_letter:
        return None
    if len(parts) == 1:
        return parts[0]
    for grams, counts in parts:
        for g, n in zip(grams.tolist(), counts.tolist()):
            found[g] = found.get(g, 0) + n
    return np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each language a task has read, its trigrams' shares, added up over documents."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            if found := count_grams(text):
                grams, counts = found
                if lang not in totals:
                    totals[lang] = np.zeros(CLASSES**GRAM, np.float32)
                totals[lang][grams] += counts / counts.sum()
    letters = letter_vectors()
    for lang, total in totals.items():
        bundle = np.zeros(DIMENSIONS)
        grams = np.flatnonzero(total)
        for at in range(0, len(grams), 4096):
            some = grams[at : at + 4096]
            bundle += total[some].astype(np.float64) @ gram_vectors(some, letters)
        yield pd.DataFrame({"lang": lang, "at": np.arange(DIMENSIONS), "value": bundle})


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and their unit vectors, from rows (text, lang) with a language.

    Each task bundles what it reads; Spark adds the bundles up, DIMENSIONS numbers for each language and
    task. A language is left out if its texts have no letter."""
    rows = docs.filter("lang is not null").select("lang", "text").mapInPandas(_profile, "lang string, at int, value double")
    # rounding makes the sum of the tasks' numbers independent of their order
    sums = rows.groupBy("lang", "at").agg(F.sum(F.round("value", 6).cast("decimal(28,6)")).cast("double").alias("value")).collect()
    languages = sorted({r["lang"] for r in sums})
    vectors = np.zeros((len(languages), DIMENSIONS))
    for r in sums:
        vectors[languages.index(r["lang"]), r["at"]] = r["value"]
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return languages, vectors / np.where(norms > 0, norms, 1)


def _predictor(shared):
    letters: list[np.ndarray] = []

    def predict(texts: pd.Series) -> pd.DataFrame:
        languages, vectors = shared.value
        if not letters:
            letters.append(letter_vectors())
        rows = []
        for text in texts:
            found = count_grams(text) if languages else None
            if not found:
                rows.append((UNKNOWN, 0.0))
                continue
            grams, counts = found
            bundle = np.zeros(DIMENSIONS)
            for at in range(0, len(grams), 2048):
                some = gram_vectors(grams[at : at + 2048], letters[0])
                bundle += counts[at : at + 2048].astype(np.float32) @ some.astype(np.float32)
            cosines = vectors @ bundle / max(np.linalg.norm(bundle), 1e-12)
            best = int(np.argmax(cosines))
            rows.append((languages[best], float(min(1.0, max(0.0, cosines[best])))))
        return pd.DataFrame(rows, columns=["lang_pred", "score"])

    predict.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return predict


def identify(docs: DataFrame, languages: list[str], vectors: np.ndarray) -> DataFrame:
    """`docs` with columns lang_pred and score: the language of the nearest prototype and its cosine, at least 0.

    A null text, and one without a letter, is `und` with score 0; so is every text if nothing was
    learned. Ties go to the language that comes first in the alphabet."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, vectors))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = F.pandas_udf(_predictor(shared), "lang_pred string, score double")("text").alias("found")
    return docs.select(F.struct(*keep).alias("row"), found).select("row.*", "found.*")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = prototypes(docs.filter(fold(F.col("doc_id"), 5) != 0))
    return identify(docs.select("doc_id", "text"), *learned).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
