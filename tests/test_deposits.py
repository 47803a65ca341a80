"""Deposits that hold, and each way in which one doesn't."""

import hashlib
import json

import pytest

from plumbline.operators.checks import DataError
from plumbline.sources.deposits import load_deposit, table_lines


def said(content, name="w.bin"):
    return {"name": name, "size_bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}


def deposit(tmp_path, manifest=None, readme="# A model\n\n```\n| a |\n|---|\n```\n", metadata=None, without=()):
    d, a = tmp_path / "d", tmp_path / "a"
    d.mkdir()
    a.mkdir()
    (a / "w.bin").write_bytes(b"weights")
    (a / "notes.txt").write_bytes(b"not listed")
    whole = {"schema_version": 1, "community": "c", "inference_requirements": {"python": "3"}, "artifacts": [said(b"weights")]} | (manifest or {})
    for name, text in (("manifest.json", json.dumps(whole)), ("metadata.json", json.dumps(metadata or {})), ("README.md", readme), ("model.json", "{}")):
        if name not in without:
            (d / name).write_text(text)
    return str(d), str(a)


def test_a_deposit_that_holds(spark, tmp_path):
    found = load_deposit(spark, *deposit(tmp_path, metadata={"title": "t", "files": {"default_preview": "README.md"}}))
    assert found.community == "c" and found.metadata["title"] == "t"
    assert {r.name: r.sha256 for r in found.files.collect()}["w.bin"] == said(b"weights")["sha256"]
    assert {r.name for r in found.files.collect()} == {"w.bin", "README.md", "manifest.json", "model.json"}


@pytest.mark.parametrize(
    "broken,kind,message",
    [
        ({"without": ["model.json"]}, FileNotFoundError, "model.json"), ({"manifest": {"schema_version": 2}}, DataError, "version"), ({"manifest": {"community": ""}}, DataError, "community"),
        ({"manifest": {"artifacts": []}}, DataError, "one at least"), ({"manifest": {"artifacts": [said(b"weights")] * 2}}, DataError, "twice"), ({"manifest": {"artifacts": [said(b"x", "README.md")]}}, DataError, "own files"),
        ({"manifest": {"artifacts": [said(b"other!!")]}}, DataError, "wrong_digests"), ({"manifest": {"artifacts": [said(b"longer one")]}}, DataError, "wrong_sizes"), ({"manifest": {"artifacts": [said(b"x", "gone.bin")]}}, DataError, "stale"),
        ({"manifest": {"artifacts": [said(b"weights") | {"more": 1}]}}, DataError, "a size and a digest"), ({"manifest": {"inference_requirements": {}}}, DataError, "inference"),
        ({"readme": "text\n| a | b |\n|---|---|\n"}, DataError, "lines 3"), ({"metadata": {"files": {"default_preview": "x.png"}}}, DataError, "preview"),
    ],
)
def test_deposits_that_do_not_hold(spark, tmp_path, broken, kind, message):
    with pytest.raises(kind, match=message):
        load_deposit(spark, *deposit(tmp_path, **broken))


def test_lines_of_tables(spark, tmp_path):
    (tmp_path / "r.md").write_text("a\r\n|--|\n~~~\n|--|\n~~~\n-|-")
    assert list(table_lines(spark, str(tmp_path / "r.md"))) == [2, 6]
    (tmp_path / "e.md").write_text("")
    assert list(table_lines(spark, str(tmp_path / "e.md"))) == []
