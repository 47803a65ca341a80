"""Chat formatting: every assistant turn as an example of its own, after all turns before it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact, longs, new_path, numbers, table

# Fixed values of the template: what begins a turn, what ends it, and the sign that escapes both in texts.
BEGIN, END, ESCAPE = "### ", "</turn>", "\\"
#: The role whose texts are learned from.
TRAINED = "assistant"

TURNS = "conv_id long, turn long, role string, formatted string, text_start long, text_length long, turn_start long, example long, position long"


def escape(text: str) -> str:
    """The text without the template's control strings: a sign before each, and before each sign itself."""
    return text.replace(ESCAPE, ESCAPE * 2).replace(BEGIN, ESCAPE + BEGIN).replace(END, ESCAPE + END)


def unescape(text: str) -> str:
    out, at = [], 0
    while (found := text.find(ESCAPE, at)) >= 0:
        out += [text[at:found], text[found + 1 : found + 2]]
        at = found + 2
    return "".join([*out, text[at:]])


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The turn as it is written, and where its escaped text stands in it.

    A role is escaped too; of a missing one nothing is written."""
    head = f"{BEGIN}{escape(role).replace(':', ESCAPE + ':') if role is not None else ESCAPE + '0'}: "
    body = escape(text or "")
    return f"{head}{body}{END}\n", len(head), len(body)


def parse_turn(formatted: str) -> tuple[str | None, str]:
    """Role and text of a written turn."""
    if not formatted.startswith(BEGIN) or not formatted.endswith(END + "\n"):
        raise ValueError("not a turn of this template")
    at = len(BEGIN)
    while formatted[at] != ":":
        at += 2 if formatted[at] == ESCAPE else 1
    role = formatted[len(BEGIN) : at]
    return None if role == ESCAPE + "0" else unescape(role), unescape(formatted[at + 2 : -len(END) - 1])


def _frame(rows: list[tuple], schema: str, *nullable: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pd.DataFrame({n: longs(list(c)) if n in nullable else pd.Series(c, dtype=None if c else object) for n, c in zip(names, columns)})


def _format(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come ordered by conversation and turn; what a task remembers is a position and two counts."""
    now, place, example, position = object(), 0, 0, 0
    for batch in batches:
        rows = []
        for conv, turn, role, text in zip(numbers(batch["conv"]), numbers(batch["turn"]), batch["role"], batch["text"]):
            if conv != now:
                now, place, example, position = conv, 0, 0, 0
            formatted, start, length = format_turn(role, text)
            trained = role == TRAINED
            rows.append((conv, turn, role, formatted, start, length, place, example if trained else None, position))
            place += len(formatted)
            position += 1
            example += trained
        yield _frame(rows, TURNS, "conv_id", "turn", "example")


def _ordered(rows: DataFrame, *order: str, ids: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Rows of a conversation together and in order; ids as texts, on their way to Python."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, order[0]).sortWithinPartitions(*order).select(*exact(*ids), *(c for c in rows.columns if c not in ids))


def write_examples(conversations: DataFrame, path: str) -> None:
    """Writes all examples: one for every assistant turn, its context the turns before it, its mask that reply.

    Contexts share their beginnings, so they are not copied: each turn is written once, in place
    (`turn_start`, in characters of its conversation), and the example of a reply is the conversation's
    text up to its end. An example's mask is its last turn's text. That keeps what is written in
    proportion to what is read, however long a conversation is; `examples` puts them together.

    Rows are (conv_id, turn, role, text): a null text is empty; turns of equal numbers are ordered by
    role and text; a null conv_id is a conversation of its own, a null turn comes first."""
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    turns = _ordered(rows, "conv", "turn", "role", "text", ids=("conv", "turn")).mapInPandas(_format, TURNS)
    turns.write.parquet(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TURNS).parquet(path)


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example, context, reply, mask_start, mask_end (in context + reply) with full texts.

    Each example repeats all turns before it, as training needs; for conversations of bounded length."""
    replies = turns.filter("example is not null").select(
        F.col("conv_id").alias("c"), F.col("example").alias("n"), F.col("turn_start").alias("until"), F.col("formatted").alias("reply"),
        F.col("text_start").alias("mask"), F.col("text_length").alias("masked"),
    )
    joined = replies.join(turns.select("conv_id", "turn_start", "formatted"), F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("turn_start") < F.col("until")), "left")
    before = F.array_sort(F.collect_list(F.when(F.col("turn_start").isNotNull(), F.struct("turn_start", "formatted"))))
    whole = joined.groupBy("c", "n", "until", "reply", "mask", "masked").agg(F.concat_ws("", F.transform(before, lambda t: t["formatted"])).alias("context"))
    return whole.select(
        F.col("c").alias("conv_id"), F.col("n").alias("example"), "context", "reply",
        (F.col("until") + F.col("mask")).alias("mask_start"), (F.col("until") + F.col("mask") + F.col("masked")).alias("mask_end"),
    )


PIECES = "conv_id long, example long, position long, piece string, mask_start long, mask_length long"
#: Positions of a conversation that are joined with its replies at once.
RANGE = 64


def write_expanded(turns: DataFrame, path: str) -> None:
    """Writes every example in full, a row for each of its turns: the context's, then the reply with its mask.

    Only the mask's characters are trainable: those of the last piece from `mask_start` on. A long context
    is many rows, none of which is longer than a turn. Replies are joined with the turns before them by ranges of positions, so a
    conversation is as many keys as it has ranges, and no task holds one."""
    replies = turns.filter("example is not null").select(F.col("conv_id").alias("c"), "example", F.col("position").alias("until"))
    wanted = replies.withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("until") / RANGE))))
    held = turns.select("conv_id", "position", F.col("formatted").alias("piece"), "text_start", "text_length", F.floor(F.col("position") / RANGE).alias("of"))
    met = wanted.join(held, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("range") == F.col("of")) & (F.col("position") <= F.col("until")))
    mask = [F.when(F.col("position") == F.col("until"), F.col(c)).otherwise(F.lit(0)).cast("long").alias(n) for c, n in (("text_start", "mask_start"), ("text_length", "mask_length"))]
    met.select("conv_id", "example", "position", "piece", *mask).write.parquet(path)


def read_expanded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PIECES).parquet(path)


LOSSES = "c long, loss_chars long, loss_sha256 string, n_examples long"


def _loss(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, state, rows = object(), None, []

    def closed() -> None:
        if state:
            rows.append((now, state[0], state[1].hexdigest(), state[2]))

    for batch in batches:
        for conv, piece, start, length in zip(numbers(batch["conv_id"]), batch["piece"], batch["mask_start"], batch["mask_length"]):
            if conv != now:
                closed()
                now, state = conv, [0, hashlib.sha256(), 0]
            masked = unescape(piece[start : start + length])
            state[0] += len(masked)
            state[1].update(masked.encode())
            state[2] += 1
        if rows:
            yield _frame(rows, LOSSES, "c")
            rows = []
    closed()
    if rows:
        yield _frame(rows, LOSSES, "c")


def example_digests(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """As `digests`, with what is trained on read from the masks of the examples that are whole.

    An example counts if its pieces are as many as its last position says."""
    whole = pieces.groupBy("conv_id", "example").agg(F.count("*").alias("n"), F.max("position").alias("position"), F.max_by("piece", "position").alias("piece"), *(F.max_by(c, "position").alias(c) for c in ("mask_start", "mask_length")))
    losses = _ordered(whole.filter("n = position + 1").select("conv_id", "example", "piece", "mask_start", "mask_length"), "conv_id", "example").mapInPandas(_loss, LOSSES)
    read = digests(turns).drop("loss_chars", "loss_sha256", "n_examples").join(losses, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    filled = {"loss_chars": F.coalesce("loss_chars", F.lit(0)), "loss_sha256": F.coalesce("loss_sha256", F.sha2(F.lit(""), 256)), "n_examples": F.coalesce("n_examples", F.lit(0))}
    return read.withColumns(filled).select(*(c.split()[0] for c in DIGESTS.split(", ")))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, state = object(), None
    rows: list[tuple] = []

    def closed() -> None:
        if state:
            n, turns, chars, loss, formatted, n_examples = state
            rows.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, n_examples))

    for batch in batches:
        for conv, formatted, start, length, example in zip(
            numbers(batch["conv_id"]), batch["formatted"], batch["text_start"], batch["text_length"], numbers(batch["example"])
        ):
            if conv != now:
                closed()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            role, text = parse_turn(formatted)
            state[0] += 1
            state[1].update(f"{role or ''}\n{text}\n".encode())
            state[4] += len(formatted)
            if example is not None:
                masked = unescape(formatted[start : start + length])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[5] += 1
        if rows:
            yield _frame(rows, DIGESTS, "conv_id")
            rows = []
    closed()
    if rows:
        yield _frame(rows, DIGESTS, "conv_id")


def digests(turns: DataFrame) -> DataFrame:
    """What a reader finds in each conversation; texts stream through hashes, so length needs no memory."""
    return _ordered(turns.select("conv_id", "turn_start", "formatted", "text_start", "text_length", "example"), "conv_id", "turn_start", ids=("conv_id", "example")).mapInPandas(_digest, DIGESTS)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = new_path(spark, "chat")
    write_examples(rows.unionByName(more), path)
    turns, expanded = read_turns(spark, path), new_path(spark, "chat-examples")
    write_expanded(turns, expanded)
    return example_digests(turns, read_expanded(spark, expanded))
