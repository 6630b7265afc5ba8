"""Versioned manifests: immutable JSON snapshots, committed by creating the next version if nobody has.

A data file becomes visible when a manifest names it, and readers keep to the version that they
opened, so commits never disturb them.  All access goes through Hadoop's file systems.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TableLocked(RuntimeError):
    """Another writer committed first."""


class Store:
    """Files below a path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, jvm = spark, path.rstrip("/"), spark._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def list(self, sub: str) -> list[tuple[str, int]]:
        at = self._path(f"{self.path}/{sub}")
        return [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def walk(self, sub: str) -> list[tuple[str, int]]:
        """(path below the table, size) of all files."""
        out = []
        for s in self._fs.listStatus(self._path(f"{self.path}/{sub}")) if self._fs.exists(self._path(f"{self.path}/{sub}")) else []:
            name = f"{sub}/{s.getPath().getName()}"
            out += self.walk(name) if s.isDirectory() else [(name, s.getLen())]
        return out

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        try:
            stream = self._fs.create(self._path(f"{self.path}/{name}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()) or "already exists" in str(e.java_exception):
                raise TableLocked(f"{name} has been committed by another writer") from None
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def put(self, name: str, pieces: Iterable[bytes]) -> None:
        """Writes a file anew, piece by piece."""
        stream = self._fs.create(self._path(f"{self.path}/{name}"), True)
        try:
            for piece in pieces:
                stream.write(bytearray(piece))
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)


#: What a commit changes or hands on.
STATE = ("runs", "blobs", "next_seq", "next_segment", "batches", "settled", "own_seq")


class Manifest:
    """One version: runs, blob files, counters, and what is known of the operations to come.

    ``settled`` is a promise that no later operation has this seq or a lower one, so tombstones up to it
    may go; ``own_seq`` tells that every seq so far was given by the table, in ascending order.
    """

    def __init__(self, version: int = 0, runs=(), blobs=(), next_seq: int = 1, next_segment: int = 1, batches=None, settled: int = -(1 << 63), own_seq: bool = True):
        self.version, self.runs, self.blobs = version, list(runs), list(blobs)
        self.next_seq, self.next_segment, self.batches = next_seq, next_segment, dict(batches or {})
        self.settled, self.own_seq = settled, own_seq

    def to_json(self) -> str:
        b64 = lambda b: base64.b64encode(b).decode()
        runs = [{**r, "smallest": b64(r["smallest"]), "largest": b64(r["largest"])} for r in self.runs]
        return json.dumps({"format": 1, "version": self.version, **{k: getattr(self, k) for k in STATE}, "runs": runs})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        d = json.loads(text)
        if d.get("format") != 1:
            raise ValueError("manifest: unsupported format")
        runs = [{**r, "smallest": base64.b64decode(r["smallest"]), "largest": base64.b64decode(r["largest"])} for r in d["runs"]]
        return cls(d["version"], **{k: d[k] for k in STATE if k in d} | {"runs": runs})


def versions(store: Store) -> list[int]:
    return sorted(int(n[1:-5]) for n, _ in store.list("_manifest") if n.startswith("v") and n.endswith(".json"))


def load(store: Store, version: int | None = None) -> Manifest:
    """The given version, or the newest; an empty version 0 where there is none."""
    held = versions(store)
    if version is None and not held:
        return Manifest()
    if version == 0:
        return Manifest()
    return Manifest.from_json(store.read(f"_manifest/v{held[-1] if version is None else version:010d}.json"))


def commit(store: Store, base: Manifest, **changes) -> Manifest:
    new = Manifest(base.version + 1, **{k: changes.get(k, getattr(base, k)) for k in STATE})
    store.create(f"_manifest/v{new.version:010d}.json", new.to_json())
    return new


def run_metadata(spark: SparkSession, files: list[str], level: int, created_at: int, root: str) -> list[dict]:
    """Bounds and sizes of run files, one task a file; reads the key column alone."""
    if not files:
        return []
    df: DataFrame = spark.read.schema("key binary, seq bigint").parquet(*files).select("key", "seq", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"))
    rows = df.groupBy("f").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.max("s").alias("s"), F.count("*").alias("n"), F.max("seq").alias("q"), F.min("seq").alias("p")).collect()
    out = [
        {
            "filename": root + "/" + r.f.rsplit(f"/{root}/", 1)[1], "level": level, "smallest": bytes(r.lo), "largest": bytes(r.hi), "size_bytes": r.s,
            "created_at": created_at, "n_entries": r.n, "max_seq": r.q, "min_seq": r.p,
        }
        for r in rows
    ]
    return sorted(out, key=lambda m: (m["smallest"], m["filename"]))


def blob_metadata(spark: SparkSession, files: list[tuple[str, int]], path: str, root: str) -> list[dict]:
    """Sizes and segment bounds of blob files (name below path, size); reads the segment column alone."""
    if not files:
        return []
    held = spark.read.schema("segment_id bigint").parquet(*[f"{path}/{n}" for n, _ in files]).select("segment_id", F.col("_metadata.file_path").alias("f"))
    rows = held.groupBy("f").agg(F.min("segment_id").alias("lo"), F.max("segment_id").alias("hi")).collect()
    bounds = {root + "/" + r.f.rsplit(f"/{root}/", 1)[1]: (r.lo, r.hi) for r in rows}
    return [{"filename": n, "size_bytes": s, "lo": bounds[n][0], "hi": bounds[n][1]} for n, s in files if n in bounds]
