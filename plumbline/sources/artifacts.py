"""Pinned files that a computation depends on: found, held against their digests, and sent once to each executor."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import SparkFiles
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Artifact:
    """A file of a record, and the digest that it must have."""

    name: str
    record_id: str
    file: str
    sha256: str


def resolve(spark: SparkSession, artifacts: Sequence[Artifact], cache: str | None = None, overrides: Mapping[str, str] | None = None) -> dict[str, str]:
    """name -> path of each artifact, in whichever store Spark reaches: that of `overrides`, else <cache>/<record>/<file>.

    A file that isn't there is an error, and so is one with another digest, an override's too. Files are hashed where they are read."""
    found: dict[str, str] = {}
    for a in artifacts:
        path = (overrides or {}).get(a.name)
        if path is None:
            if cache is None:
                raise FileNotFoundError(f"{a.name} has no path and there is no cache to look in")
            path = f"{cache.rstrip('/')}/{a.record_id}/{a.file}"
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(place) or not store.getFileStatus(place).isFile():
            raise FileNotFoundError(f"{path} is missing: {a.name} is the file {a.file} of the record {a.record_id}")
        digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
        if digest != a.sha256:
            raise ValueError(f"{path} has the digest {digest}, {a.name} is pinned to {a.sha256}")
        found[a.name] = path
    return found


_CHECKED: dict[str, tuple] = {}


@dataclass(frozen=True)
class Sent:
    """Artifacts as tasks see them: name -> (file, digest). Goes along in a function's closure."""

    files: dict[str, tuple[str, str]]

    def path(self, name: str) -> str:
        """Where the executor has an artifact. It is hashed before a worker uses it first, and again if it changes."""
        file, digest = self.files[name]
        path = SparkFiles.get(file)
        state = os.stat(path)
        seen = (digest, state.st_size, state.st_mtime_ns)
        if _CHECKED.get(path) != seen:
            with open(path, "rb") as f:
                found = hashlib.file_digest(f, "sha256").hexdigest()
            if found != digest:
                raise ValueError(f"{name} on this executor has the digest {found}, not {digest}")
            _CHECKED[path] = seen
        return path


def send(spark: SparkSession, artifacts: Sequence[Artifact], paths: Mapping[str, str]) -> Sent:
    """Sends resolved artifacts to the executors, each once; two that end in one file name can't be told apart there."""
    names = [os.path.basename(paths[a.name]) for a in artifacts]
    if len(set(names)) < len(names):
        raise ValueError(f"artifacts need files of different names, not {sorted(names)}")
    for a in artifacts:
        spark.sparkContext.addFile(paths[a.name])
    return Sent({a.name: (n, a.sha256) for a, n in zip(artifacts, names)})
