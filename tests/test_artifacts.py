"""Pinned files: override before cache, digests on the driver and on executors."""

import hashlib

import pandas as pd
import pytest
from pyspark import SparkFiles

from plumbline.plans.models import served
from plumbline.sources.artifacts import Artifact, resolve, send


def pinned(name, content, file=None):
    return Artifact(name, "rec-1", file or f"{name}.bin", hashlib.sha256(content).hexdigest())


def test_resolve(spark, tmp_path):
    a, b = pinned("weights", b"abc"), pinned("table", b"xyz")
    (tmp_path / "cache" / "rec-1").mkdir(parents=True)
    (tmp_path / "cache" / "rec-1" / "weights.bin").write_bytes(b"abc")
    (tmp_path / "mine.bin").write_bytes(b"xyz")
    cache = str(tmp_path / "cache")
    assert resolve(spark, [a], cache) == {"weights": f"{cache}/rec-1/weights.bin"}
    assert resolve(spark, [a, b], cache, {"table": str(tmp_path / "mine.bin")})["table"].endswith("mine.bin")
    assert resolve(spark, [b], None, {"table": str(tmp_path / "mine.bin")}) and resolve(spark, []) == {}
    for found, said in ((lambda: resolve(spark, [b], cache), "missing"), (lambda: resolve(spark, [a]), "no cache")):
        with pytest.raises(FileNotFoundError, match=said):
            found()
    with pytest.raises(ValueError, match="pinned"):  # an override is held against the digest as well, before the cache's good file
        resolve(spark, [a], cache, {"weights": str(tmp_path / "mine.bin")})


def test_sent_files_are_checked_where_they_are_used(spark, tmp_path):
    (tmp_path / "scale.txt").write_text("3")
    a = pinned("scale", b"3", "scale.txt")
    sent = send(spark, [a], resolve(spark, [a], None, {"scale": str(tmp_path / "scale.txt")}))

    def make():
        with open(sent.path("scale")) as f:
            factor = int(f.read())
        return lambda batch: pd.DataFrame({"y": batch["id"] * factor})

    assert [r.y for r in served(spark.range(4), make, "y long").orderBy("y").collect()] == [0, 3, 6, 9]
    with open(SparkFiles.get("scale.txt"), "w") as f:
        f.write("4")
    with pytest.raises(Exception, match="on this executor has the digest"):
        served(spark.range(4), make, "y long").collect()
    with pytest.raises(ValueError, match="different names"):
        send(spark, [a, a], {"scale": str(tmp_path / "scale.txt")})
