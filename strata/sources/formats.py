"""Binary files of the storage model as DataFrames: write-ahead logs, sorted runs, value logs, manifests.

Files come through Spark's ``binaryFile`` source, so any store that Spark reads will do, and each is
decoded by one task (the formats have no split points).  In a write-ahead log a torn tail is dropped, and
a checksum mismatch fails (on_damage "fail") or ends the log there ("truncate").  Of value logs only
the newest segment may end in a bad or torn record, which is dropped; a sealed one fails.

Written files are encoded by tasks, one a file, and stored by the driver piece by piece.
"""

from __future__ import annotations

import base64
import itertools
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.bloom import Bloom
from strata.functions.encoding import segment_name
from strata.schema import BLOCK_BYTES, TOMBSTONE
from strata.sources.manifest import Store

# Fixed values of the run footer: magic and version.
RUN_MAGIC, RUN_VERSION = 0xFF12FF45, 2
_RECORD, _FOOTER = struct.Struct("<III"), struct.Struct("<QIB")


class Damaged(ValueError):
    """A file that does not hold what its format promises."""


def encode_record(key: bytes, value: bytes) -> bytes:
    body = struct.pack("<II", len(key), len(value)) + key + value
    return struct.pack("<I", zlib.crc32(body)) + body


def records(data: bytes, on_damage: str = "fail", sealed: bool = False) -> Iterator[tuple[int, bytes, bytes]]:
    """(position, key, value) of a log's records; a sealed log has to end with a whole one."""
    at = 0
    while at < len(data):
        crc, k, v = _RECORD.unpack_from(data, at) if at + _RECORD.size <= len(data) else (0, len(data), 0)
        end = at + _RECORD.size + k + v
        if end > len(data):
            if sealed:
                raise Damaged(f"record at {at}: torn in a sealed log")
            return
        if zlib.crc32(data[at + 4 : end]) != crc:
            if on_damage == "truncate":
                return
            raise Damaged(f"record at {at}: checksum")
        yield at, data[at + 12 : at + 12 + k], data[at + 12 + k : end]
        at = end


def encode_run(entries: list[tuple[bytes, bytes]], fpp: float = 0.01) -> bytes:
    """A sorted run's file; an entry must fit a block."""
    bloom = Bloom.sized(len(entries), fpp)
    bloom.add(k for k, _ in entries)
    head, blocks, index, block, first = bloom.to_bytes(), [], [], b"", b""
    at = len(head)

    def close():
        nonlocal at, block
        if block:
            index.append(struct.pack("<H", len(first)) + first + struct.pack("<QI", at, len(block)))
            blocks.append(block)
            at += len(block)
            block = b""

    for k, v in entries:
        e = struct.pack("<HI", len(k), len(v)) + k + v
        if len(e) > BLOCK_BYTES:
            raise ValueError("an entry does not fit a block")
        if block and len(block) + len(e) > BLOCK_BYTES:
            close()
        if not block:
            first = k
        block += e
    close()
    return head + b"".join(blocks) + b"".join(index) + _FOOTER.pack(at, RUN_MAGIC, RUN_VERSION)


def run_index(data: bytes) -> list[tuple[bytes, int, int]]:
    """(first key, offset, length) of a run's blocks."""
    if len(data) < _FOOTER.size:
        raise Damaged("run: too short")
    at, magic, version = _FOOTER.unpack_from(data, len(data) - _FOOTER.size)
    end = len(data) - _FOOTER.size
    if magic != RUN_MAGIC or version != RUN_VERSION:
        raise Damaged("run: footer")
    try:
        head = Bloom.leading(data[:end])
    except ValueError as e:
        raise Damaged(f"run: {e}") from None
    if not head <= at <= end:
        raise Damaged("run: index offset")
    out = []
    while at < end:
        if at + 2 > end:
            raise Damaged("run: index")
        (n,) = struct.unpack_from("<H", data, at)
        if at + 2 + n + 12 > end:
            raise Damaged("run: index")
        offset, length = struct.unpack_from("<QI", data, at + 2 + n)
        out.append((data[at + 2 : at + 2 + n], offset, length))
        at += 14 + n
    return out


def run_entries(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    for _, at, length in run_index(data):
        end = at + length
        while at < end:
            k, v = struct.unpack_from("<HI", data, at)
            if at + 6 + k + v > end:
                raise Damaged("run: block")
            yield data[at + 6 : at + 6 + k], data[at + 6 + k : at + 6 + k + v]
            at += 6 + k + v


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _decoded(files: DataFrame, decode, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = []
                for row in decode(data):
                    held.append((path, *row))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*held, strict=True)), strict=True)))
                        held = []
                if held:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*held, strict=True)), strict=True)))

    return files.mapInArrow(run, schema)


LOG = "path string, pos bigint, key binary, value binary"


def read_wal(spark: SparkSession, path: str, on_damage: str = "fail") -> DataFrame:
    """(path, pos, key, value); a log's order is its file's name, then pos."""
    return _decoded(_files(spark, path, ".wal"), lambda d: records(d, on_damage), LOG)


def read_value_log(spark: SparkSession, path: str, on_damage: str = "newest") -> DataFrame:
    """(segment_id, offset, key, value, checksum); with on_damage "newest", only the segment of the highest number may be torn."""
    files, number = _files(spark, path, ".vlog"), F.regexp_extract("path", r"([0-9]+)\.vlog$", 1).cast("bigint")
    if on_damage == "newest":
        newest = spark.read.format("binaryFile").option("pathGlobFilter", "*.vlog").option("recursiveFileLookup", "true").load(path).agg(F.max(number)).first()[0]
        torn = _decoded(files.where(number == newest), lambda d: records(d, "truncate"), LOG)
        raw = _decoded(files.where(number != newest), lambda d: records(d, "fail", sealed=True), LOG).unionByName(torn)
    else:
        raw = _decoded(files, lambda d: records(d, on_damage), LOG)
    return raw.select(number.alias("segment_id"), F.col("pos").alias("offset"), "key", "value", F.crc32("value").alias("checksum"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of all sorted runs."""
    return _decoded(_files(spark, path, ".sst"), run_entries, "path string, key binary, value binary")


def read_run_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, first_key, offset, length) of the runs' blocks."""
    return _decoded(_files(spark, path, ".sst"), run_index, "path string, first_key binary, offset bigint, length bigint")


def _stored(rows: DataFrame, encode, order: list[str], path: str) -> list[str]:
    """Writes rows (file, key, value, ...) as one file each ``file``; (names written).

    encode makes pieces of an iterator of (key, value) of one file, in ``order``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)

        for name, own in itertools.groupby(pairs(), lambda r: r[0]):
            for piece in encode((k, v) for _, k, v in own):
                yield pa.RecordBatch.from_pydict({"file": [name], "piece": pa.array([piece], pa.binary())})

    held = rows.repartition("file").sortWithinPartitions("file", *order).select("file", "key", "value")
    store, names = Store(rows.sparkSession, path), []
    pieces = ((r["file"], bytes(r["piece"])) for r in held.mapInArrow(run, "file string, piece binary").toLocalIterator())
    for name, own in itertools.groupby(pieces, lambda r: r[0]):
        store.put(name, (p for _, p in own))
        names.append(name)
    return names


def _framed(pairs: Iterator[tuple[bytes, bytes]]) -> Iterator[bytes]:
    held, n = [], 0
    for k, v in pairs:
        held.append(encode_record(bytes(k), bytes(v)))
        n += len(held[-1])
        if n >= 1 << 20:
            yield b"".join(held)
            held, n = [], 0
    yield b"".join(held)


def write_wal(ops: DataFrame, path: str, tombstone: bytes = TOMBSTONE) -> list[str]:
    """Writes operations (file, seq, key, deleted, value) as write-ahead logs below path, in seq order; returns their names."""
    value = F.when(F.col("deleted"), F.lit(tombstone)).otherwise(F.col("value").cast("binary"))
    return _stored(ops.select("file", "seq", F.col("key").cast("binary").alias("key"), value.alias("value")), _framed, ["seq"], path)


def write_value_log(blobs: DataFrame, path: str) -> list[str]:
    """Writes values (segment_id, offset, key, value) as value-log segments; records stand at their offsets if these leave no gap."""
    return _stored(blobs.withColumn("file", segment_name("segment_id")), _framed, ["offset"], path)


def write_runs(entries: DataFrame, path: str, fpp: float = 0.01) -> list[str]:
    """Writes entries (file, key, value) with unique keys as sorted runs; a task holds one run's entries."""
    return _stored(entries, lambda pairs: [encode_run([(bytes(k), bytes(v)) for k, v in pairs], fpp)], ["key"], path)


def encode_manifest(tables: list[dict]) -> bytes:
    made = [{**t, **{k: base64.b64encode(t[k]).decode() for k in ("smallest", "largest")}} for t in tables]
    return json.dumps({"version": 1, "tables": made}).encode()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """META rows of a JSON manifest."""
    table = "filename: string, level: int, smallest: string, largest: string, size_bytes: bigint, created_at: bigint"
    held = spark.read.schema(f"version int, tables array<struct<{table}>>").json(path, multiLine=True)
    good = F.when(F.col("version") == 1, F.col("tables")).otherwise(F.raise_error(F.lit("manifest: unsupported version")).cast(held.schema["tables"].dataType))
    t = held.select(F.explode(good).alias("t")).select("t.*")
    return t.withColumn("smallest", F.unbase64("smallest")).withColumn("largest", F.unbase64("largest"))
