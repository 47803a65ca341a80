"""Token ids as Simple-8b words: a block format, its writer in document order, and its reader.

A block holds the ids of whole documents. Its payload, little-endian throughout:

    4 bytes  "S8B1"
    u32      ids in the block            (n)
    u32      ids in a frame              (f)
    u32      escapes                     (e)
    u32 * (frames + 1)                   offset of each frame's first word, and the number of words
    padding to a multiple of 8 bytes
    (u64, u64) * e                       position and value of each id of 2**60 or more, written as 0 in its word
    u64 * words                          4 bits of selector above 60 bits of ids, the first id lowest

Each frame starts a word of its own, so frames can be decoded alone and all of them at once."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact, new_path, numbers, table
from .tokens import VOCABULARY, word_tokens

MAGIC = b"S8B1"
# Fixed values of Simple-8b: ids in a word and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Values from which on a selector's bits are too few.
LIMITS = np.uint64(1) << BITS.astype(np.uint64)
#: The least selector with enough bits, for ids of up to 16.
ENOUGH = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)
FRAME = 4096
BLOCK = 1 << 16
LIMIT = np.uint64(1 << 60)
BLOCK_SCHEMA = "shard int, block long, shard_start long, n_ids long, doc_ids array<long>, known array<boolean>, doc_lengths array<long>, payload binary"


def _runs(fits: np.ndarray, length: int) -> np.ndarray:
    """Where `length` places that fit begin, along rows that are true beyond their ends."""
    out, have = fits, 1
    while have < length:
        step = min(have, length - have)
        out = out[:, :-step] & out[:, step:]
        have += step
    return out


def encode_block(ids: np.ndarray, frame: int = FRAME) -> bytes:
    """The payload for `ids`, unsigned integers of up to 64 bits."""
    n, frames = len(ids), -(-len(ids) // frame)
    ids = ids.astype(np.uint64)
    escaped = np.flatnonzero(ids >= LIMIT)
    values = ids[escaped]
    ids[escaped] = 0
    # a row for each frame, with zeros after it, so that a frame's last word may say more ids than there are
    row = frame + int(COUNTS[0])
    grid = np.zeros((frames, row), np.uint64)
    full = n // frame
    grid[:full, :frame] = ids[: full * frame].reshape(full, frame)
    grid[full:, : n - full * frame] = ids[full * frame :]
    # the highest selector whose bits are enough, for each id
    selector = np.full((frames, frame), 15, np.uint8)
    low = grid.astype(np.uint16)
    enough = ENOUGH[low] if (grid == low).all() else np.searchsorted(LIMITS, grid.reshape(-1), side="right").astype(np.uint8).reshape(grid.shape)
    for s in range(14, -1, -1):
        fits = _runs(enough <= s, int(COUNTS[s]))[:, :frame]
        # a run that fits fewer bits fits more bits too, where fewer ids stand in a word
        if not fits.any():
            break
        np.copyto(selector, np.uint8(s), where=fits)
    starts, offsets = [], [0]
    for f in range(frames):
        steps = COUNTS[selector[f]].tolist()
        at, end = 0, min(frame, n - f * frame)
        while at < end:
            starts.append(f * row + at)
            at += steps[at]
        offsets.append(len(starts))
    start = np.array(starts, np.int64)
    chosen = selector[start // row, start % row]
    words = chosen.astype(np.uint64) << np.uint64(60)
    flat = grid.reshape(-1)
    for s in np.unique(chosen):
        if BITS[s]:
            rows = np.flatnonzero(chosen == s)
            places = np.arange(COUNTS[s])
            held = flat[start[rows, None] + places] << (places * BITS[s]).astype(np.uint64)
            words[rows] |= np.bitwise_or.reduce(held, axis=1)
    head = MAGIC + struct.pack("<III", n, frame, len(escaped)) + np.array(offsets, "<u4").tobytes()
    return b"".join(
        (head, b"\0" * (-len(head) % 8), np.stack([escaped.astype("<u8"), values.astype("<u8")], 1).tobytes(), words.astype("<u8").tobytes())
    )


def decode_block(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of frames `first` to `last` (excluded; all by default) as unsigned 64-bit integers."""
    if payload[:4] != MAGIC:
        raise ValueError("not a Simple-8b block")
    n, frame, e = struct.unpack_from("<III", payload, 4)
    frames = -(-n // frame)
    offsets = np.frombuffer(payload, "<u4", frames + 1, 16).astype(np.int64)
    body = 16 + 4 * (frames + 1)
    body += -body % 8
    escapes = np.frombuffer(payload, "<u8", 2 * e, body).reshape(-1, 2)
    last = frames if last is None else min(last, frames)
    low, high = first * frame, min(last * frame, n)
    if low >= high:
        return np.zeros(0, np.uint64)
    words = np.frombuffer(payload, "<u8", offsets[last] - offsets[first], body + 16 * e + 8 * int(offsets[first]))
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    # what a frame's last word says beyond the frame's end isn't there
    final = offsets[first + 1 : last + 1] - offsets[first] - 1
    total = np.cumsum(counts)
    frame_ids = np.minimum((np.arange(first, last) + 1) * frame, n) - np.arange(first, last) * frame
    counts[final] -= np.diff(total[final], prepend=0) - frame_ids
    begin = np.cumsum(counts) - counts
    out = np.zeros(high - low, np.uint64)
    for s in np.unique(chosen):
        if not BITS[s]:
            continue
        rows, places = np.flatnonzero(chosen == s), np.arange(COUNTS[s])
        held = (words[rows, None] >> (places * BITS[s]).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
        short = counts[rows] < COUNTS[s]
        out[begin[rows[~short], None] + places] = held[~short]
        for r, ids in zip(rows[short], held[short]):
            out[begin[r] : begin[r] + counts[r]] = ids[: counts[r]]
    for place, value in escapes:
        if low <= place < high:
            out[int(place) - low] = value
    return out


def _writer(vocabulary: str, end_id: int):
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, end, shard = word_tokens(vocabulary), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        block = done = 0
        doc_ids, parts, filled = [], [], 0

        def closed() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(parts), "<u4")
            # a missing id stands as 0 that isn't known
            row = (shard, block, done, len(ids), [i or 0 for i in doc_ids], [i is not None for i in doc_ids], [len(p) // 4 for p in parts], encode_block(ids))
            return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, ids in zip(numbers(batch["doc_id"]), tokens.encode_all(batch["text"])):
                parts.append(ids + end)
                doc_ids.append(doc_id)
                filled += len(parts[-1]) // 4
                if filled >= BLOCK:
                    yield closed()
                    block, done = block + 1, done + filled
                    doc_ids, parts, filled = [], [], 0
        if parts:
            yield closed()

    return blocks


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = 2) -> None:
    """Writes the ids of `docs` (doc_id long, text), each document's end id after it, in ascending doc_id order.

    Documents are dealt out by ranges of doc_id; a range is a shard, and shards follow each other by
    number. A null text is empty; a null doc_id comes first; rows of the same doc_id follow each other
    in the order of their texts. A row of the written table is a block; Spark commits a shard's file
    only when its task has ended, so a lost executor leaves no half-written shard."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text").select(*exact("doc_id"), "text")
    ordered.mapInPandas(_writer(vocabulary, end_id), BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


def _reader(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in blocks:
        for _, row in batch.iterrows():
            ids = decode_block(row["payload"]).astype("<u4")
            lengths = np.asarray(row["doc_lengths"], np.int64)
            ends = np.cumsum(lengths)
            cut = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths)]
            yield pd.DataFrame(
                {"doc_id": row["doc_ids"], "known": row["known"], "shard": row["shard"], "shard_start": row["shard_start"] + ends - lengths, "n_tokens": lengths, "ids": cut}
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers).

    Blocks are decoded where they are read. Only the ids in each shard, a row for each, are summed in
    order and sent to all tasks: that table is as long as the list of files."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    before, starts = 0, []
    for shard, n in sorted((r["shard"], r["n"]) for r in sizes):
        starts.append((shard, before))
        before += n
    shards = spark.createDataFrame(starts, "shard int, before long")
    docs = blocks.mapInPandas(_reader, "doc_id long, known boolean, shard int, shard_start long, n_tokens long, ids binary")
    return docs.join(F.broadcast(shards), "shard").select(
        F.when(F.col("known"), F.col("doc_id")).alias("doc_id"),
        (F.col("before") + F.col("shard_start")).alias("start"),
        "n_tokens",
        "ids",
    )


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
