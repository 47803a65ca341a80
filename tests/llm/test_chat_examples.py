"""op8_chat's path makes each example in full: its context's turns, its reply and the reply's mask."""

from plumbline.llm import chat
from plumbline.llm.common import new_path


def test_query_writes_examples(spark, sf, monkeypatch):
    paths = []
    monkeypatch.setattr(chat, "new_path", lambda *a: paths.append(new_path(*a)) or paths[-1])
    n = sum(r.n_examples for r in chat.op8_chat(spark, sf).collect())
    frames = [spark.read.parquet(p) for p in paths]
    pieces = next(f for f in frames if {"example", "position", "piece", "mask_start", "mask_length"} <= set(f.columns))
    assert pieces.select("conv_id", "example").distinct().count() == n > 0


def test_expanded(spark, monkeypatch):
    monkeypatch.setattr(chat, "RANGE", 2)
    rows = [(c, t, "assistant" if t % 3 == 1 else "user", f"say {c} {t} \\### </turn> ü") for c in (1, 2, None) for t in range(9)] + [(4, 0, "user", "alone"), (5, 0, "assistant", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path, expanded = new_path(spark, "test-chat"), new_path(spark, "test-chat")
    chat.write_examples(frame, path)
    turns = chat.read_turns(spark, path)
    chat.write_expanded(turns, expanded)
    pieces = chat.read_expanded(spark, expanded)
    got: dict = {}
    for r in sorted(pieces.collect(), key=lambda r: r.position):
        got.setdefault((r.conv_id, r.example), []).append(r)
    whole = {(r.conv_id, r.example): r for r in chat.examples(turns).collect()}
    assert set(got) == set(whole) and len(got) == 10
    for k, e in whole.items():
        text, at = "".join(p.piece for p in got[k]), len(e.context)
        assert text == e.context + e.reply and [p.mask_length for p in got[k][:-1]] == [0] * (len(got[k]) - 1)
        assert (at + got[k][-1].mask_start, at + got[k][-1].mask_start + got[k][-1].mask_length) == (e.mask_start, e.mask_end)
    assert sorted(map(str, chat.example_digests(turns, pieces).collect())) == sorted(map(str, chat.digests(turns).collect()))


def test_conversations_of_replies_alone_and_long_ones(spark):
    """No task holds a conversation: one of 600 turns is ten keys of a join, and replies without context are rows like others."""
    rows = [(c, 0, "assistant", f"reply {c}") for c in range(3000)] + [(-1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(600)]
    path, expanded = new_path(spark, "test-chat"), new_path(spark, "test-chat")
    chat.write_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), path)
    turns = chat.read_turns(spark, path)
    chat.write_expanded(turns, expanded)
    pieces = chat.read_expanded(spark, expanded)
    assert pieces.filter("conv_id >= 0").count() == 3000 and pieces.filter("conv_id = -1").count() == sum(t + 1 for t in range(1, 600, 2))
    found = {r.conv_id: r for r in chat.example_digests(turns, pieces).collect()}
    assert found[-1].n_examples == 300 and found[5].loss_chars == len("reply 5") and found[-1].loss_chars == sum(len(f"t{t}") for t in range(1, 600, 2))
