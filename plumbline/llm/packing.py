"""Packing into token windows: length combinations weighted by non-negative least squares, residuals packed greedily."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact, longs, numbers, table
from .tokens import VOCABULARY, word_tokens

WINDOW = 2048
#: Lengths are told apart in steps of so many tokens, and a combination has at most so many parts.
STEP = 32
DEPTH = 3
#: A gap shorter than this is padded rather than filled with a scrap of a document.
SCRAP = 16
#: Tokens that are packed together; this bounds a task's memory.
BATCH = 1 << 20

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


@cache
def combinations(steps: int = WINDOW // STEP, depth: int = DEPTH) -> np.ndarray:
    """All multisets of up to `depth` lengths (in steps) that fill a window exactly: a column of counts for each."""
    found: list[tuple[int, ...]] = []

    def extend(parts: tuple[int, ...], left: int) -> None:
        if not left:
            found.append(parts)
        elif len(parts) < depth:
            for part in range(min(left, parts[-1] if parts else steps), 0, -1):
                extend((*parts, part), left - part)

    extend((), steps)
    out = np.zeros((steps + 1, len(found)))
    for column, parts in enumerate(found):
        for part in parts:
            out[part, column] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    slack = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * n):
        gain = a.T @ (b - a @ x)
        gain[passive] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= slack:
            break
        passive[best] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            bad = passive & (z <= 1e-12)
            if not bad.any():
                x = z
                break
            ratio = x[bad] / np.maximum(x[bad] - z[bad], 1e-300)
            x = x + ratio.min() * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan(lengths: list[int], window: int = WINDOW, step: int = STEP, depth: int = DEPTH) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length) for documents of these lengths.

    Whole windows of a document come first, each a sequence. What remains of each counts into a
    histogram of lengths; repeat counts of the combinations are solved against it and rounded down.
    Documents that no combination takes fill the gaps that rounding of lengths has left and then whole
    windows, longest first, cut where a window ends. The last tokens form sequences of powers of two,
    which need no padding."""
    sequences: list[list[tuple[int, int, int]]] = []
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(window // step + 1)]
    for doc, n in enumerate(lengths):
        whole = n // window * window
        sequences += [[(doc, start, window)] for start in range(0, whole, window)]
        if n > whole:
            bins[-(-(n - whole) // step)].append((doc, whole, n - whole))
    for held in bins:
        held.sort(key=lambda p: p[2])
    ways = combinations(window // step, depth)
    repeats = np.floor(nnls(ways, np.array([len(held) for held in bins], float)) + 1e-6).astype(int)
    gaps: list[list[tuple[int, int, int]]] = []
    for way in np.argsort(-repeats, kind="stable"):
        parts = [k for k in np.flatnonzero(ways[:, way]) for _ in range(int(ways[k, way]))]
        for _ in range(repeats[way]):
            if any(len(bins[k]) < int(ways[k, way]) for k in parts):
                break
            gaps.append([bins[k].pop() for k in parts])
    left = [p for held in bins for p in held]
    left.sort(key=lambda p: p[2])

    def take(room: int) -> list[tuple[int, int, int]]:
        taken = []
        while room and left:
            doc, start, n = left.pop()
            used = min(room, n)
            taken.append((doc, start, used))
            room -= used
            if used < n:
                left.append((doc, start + used, n - used))
        return taken

    for pieces in gaps:
        room = window - sum(p[2] for p in pieces)
        sequences.append(pieces + (take(room) if room >= SCRAP else []))
    rest = sum(p[2] for p in left)
    while rest:
        size = window if rest >= window else 1 << (rest.bit_length() - 1)
        sequences.append(take(size))
        rest -= size
    return sequences


def _packer(window: int, vocabulary: str, end_id: int):
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, end = word_tokens(vocabulary), end_id.to_bytes(4, "little")
        next_id = TaskContext.get().partitionId() << 40
        docs: list[tuple[object, bytes]] = []
        held = 0

        def packed() -> pd.DataFrame:
            nonlocal next_id
            rows = []
            for sequence in plan([len(ids) // 4 for _, ids in docs], window):
                offset = 0
                for doc, start, n in sequence:
                    ids = docs[doc][1]
                    rows.append((doc, start, n, len(ids) // 4, next_id, offset, ids[4 * start : 4 * (start + n)]))
                    offset += n
                next_id += 1
            out = pd.DataFrame(rows, columns=["doc", *(c.split()[0] for c in SCHEMA.split(", ")[1:])])
            return out.assign(doc_id=longs([docs[d][0] for d in out["doc"]])).drop(columns="doc")

        for batch in batches:
            for doc_id, text in zip(numbers(batch["doc_id"]), batch["text"]):
                docs.append((doc_id, tokens.encode(text) + end))
                held += len(docs[-1][1]) // 4
                if held >= BATCH:
                    yield packed()
                    docs, held = [], 0
        if docs:
            yield packed()

    return pieces


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = 1) -> DataFrame:
    """The pieces of all documents with their ids (little-endian unsigned 32-bit integers).

    A document is its text's ids and `end_id`; a null text is empty, so every row has a piece. Rows of one
    doc_id are packed apart; a null doc_id stays null. Each task packs what it reads, up to `BATCH`
    tokens at a time, so there is no shuffle, and sequence ids begin with the task's number. Sequences
    not filled are to be padded to the window, unless their length is a power of two."""
    if window % STEP:
        raise ValueError("the window must be a multiple of the length step")
    return docs.select(*exact("doc_id"), "text").mapInPandas(_packer(window, vocabulary, end_id), SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))
