"""Membership sketches: sizing, a bit-exact filter, and its use as an aggregate and a predicate.

Inside Spark prefer the JVM's own filters (Parquet column blooms, ``might_contain`` runtime
filters).  This one fixes hash, seed and layout, for sketches that other programs read.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the serialized form: magic, version, and the multiplier of the second hash.
MAGIC, VERSION, MULTIPLIER = 0xB100F11E, 1, 0x517CC1B727220A95
_HEADER = struct.Struct("<IBQIQ")
_MASK = (1 << 64) - 1


def optimal_bits(n: int, fpp: float) -> int:
    """Bits for n members at a false-positive rate, rounded up to whole 64-bit words; at least one word."""
    if not 0 < fpp < 1:
        raise ValueError("fpp lies between 0 and 1")
    return max(64, -(-math.ceil(-max(n, 1) * math.log(fpp) / math.log(2) ** 2) // 64) * 64)


def optimal_hashes(bits: int, n: int) -> int:
    return max(1, math.floor(math.log(2) * bits / max(n, 1) + 0.5))


def sizing(n: Column, fpp: float) -> tuple[Column, Column]:
    """(bits, hashes) as columns, for counts per group."""
    least = F.greatest(n, F.lit(1))
    raw = F.ceil(least * F.lit(-math.log(fpp) / math.log(2) ** 2))
    bits = F.greatest(F.lit(64), F.ceil(raw / 64) * 64).cast("bigint")
    return bits, F.greatest(F.lit(1), F.round(F.lit(math.log(2)) * bits / least)).cast("bigint")


class Bloom:
    """Double hashing over a 64-bit hash; a probe's bit is the high half of hash x bits."""

    def __init__(self, bits: int, hashes: int, seed: int = 0, words: np.ndarray | None = None):
        if bits <= 0 or hashes <= 0:
            raise ValueError("bits and hashes are positive")
        self.bits, self.hashes, self.seed = -(-bits // 64) * 64, hashes, seed
        self.words = np.zeros(self.bits // 64, np.uint64) if words is None else words

    @classmethod
    def sized(cls, n: int, fpp: float = 0.01, seed: int = 0) -> Bloom:
        bits = optimal_bits(n, fpp)
        return cls(bits, optimal_hashes(bits, n), seed)

    def _hashes(self, keys: Iterable[bytes]) -> np.ndarray:
        import xxhash

        return np.array([xxhash.xxh3_64_intdigest(k, self.seed) for k in keys], np.uint64)

    def _places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        second = h * np.uint64(MULTIPLIER)
        low, high = np.uint64(self.bits & 0xFFFFFFFF), np.uint64(self.bits >> 32)
        for _ in range(self.hashes):
            # The high 64 bits of h * bits, from 32-bit halves.
            a, b = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)
            mid = (b * low >> np.uint64(32)) + a * low
            yield a * high + (mid + b * high >> np.uint64(32))
            h = ((h << np.uint64(5)) | (h >> np.uint64(59))) + second

    def add(self, keys: Iterable[bytes]) -> None:
        for at in self._places(self._hashes(keys)):
            np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def contains(self, keys: Iterable[bytes]) -> np.ndarray:
        h = self._hashes(keys)
        out = np.ones(len(h), bool)
        for at in self._places(h):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    def merge(self, other: Bloom) -> None:
        if (self.bits, self.hashes, self.seed) != (other.bits, other.hashes, other.seed):
            raise ValueError("filters of one shape can be merged")
        self.words |= other.words

    def reset(self) -> None:
        self.words[:] = 0

    def to_bytes(self) -> bytes:
        return _HEADER.pack(MAGIC, VERSION, self.bits, self.hashes, self.seed) + self.words.astype("<u8").tobytes()

    @staticmethod
    def leading(data: bytes) -> int:
        """The size of the filter that data starts with; its header is checked."""
        if len(data) < _HEADER.size:
            raise ValueError("bloom: too short")
        magic, version, bits, hashes, _ = _HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("bloom: magic or version")
        if bits <= 0 or bits % 64 or hashes <= 0 or len(data) < _HEADER.size + bits // 8:
            raise ValueError("bloom: sizes do not agree")
        return _HEADER.size + bits // 8

    @classmethod
    def from_bytes(cls, data: bytes) -> Bloom:
        if len(data) < _HEADER.size:
            raise ValueError("bloom: too short")
        magic, version, bits, hashes, seed = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("bloom: wrong magic")
        if version != VERSION:
            raise ValueError("bloom: unsupported version")
        if bits <= 0 or bits % 64 or hashes <= 0 or len(data) != _HEADER.size + bits // 8:
            raise ValueError("bloom: sizes do not agree")
        return cls(bits, hashes, seed, np.frombuffer(data, "<u8", offset=_HEADER.size).astype(np.uint64))


def build(df: DataFrame, n: int, key: str = "key", fpp: float = 0.01, seed: int = 0) -> Bloom:
    """A filter of df's keys.  Partitions send one filter each, merged in a tree of tasks, so what the driver gets is one."""
    shape = Bloom.sized(n, fpp, seed)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(shape.bits, shape.hashes, seed)
        for b in batches:
            own.add(bytes(k) if not isinstance(k, str) else k.encode() for k in b.column(0).to_pylist() if k is not None)
        yield pa.RecordBatch.from_arrays([pa.array([own.to_bytes()], pa.binary())], names=["f"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(shape.bits, shape.hashes, seed)
        for b in batches:
            for f in b.column(0).to_pylist():
                own.merge(Bloom.from_bytes(f))
        yield pa.RecordBatch.from_arrays([pa.array([own.to_bytes()], pa.binary())], names=["f"])

    parts = df.select(key).mapInArrow(fold, "f binary")
    n_parts = parts.rdd.getNumPartitions()
    while n_parts > 32:
        n_parts = -(-n_parts // 32)
        parts = parts.repartition(n_parts).mapInArrow(join, "f binary")
    for r in parts.coalesce(1).mapInArrow(join, "f binary").collect():
        shape.merge(Bloom.from_bytes(bytes(r.f)))
    return shape


#: Bits of a filter that may be broadcast (32 MB); beyond it, shards are built and probed each in its own tasks.
BROADCAST_BITS = 1 << 28


def probe(df: DataFrame, bloom: Bloom, key: str = "key", out: str = "might_contain") -> DataFrame:
    """df plus whether the filter may hold the row's key; the filter is broadcast, so its size is bounded."""
    if bloom.bits > BROADCAST_BITS:
        raise ValueError(f"a filter of {bloom.bits} bits is not broadcast: use build_shards and probe_shards")
    held, at = df.sparkSession.sparkContext.broadcast(bloom.to_bytes()), df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom.from_bytes(held.value)
        for b in batches:
            keys = [k.encode() if isinstance(k, str) else bytes(k or b"") for k in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.contains(keys))], names=[*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, `{out}` boolean")


def _sharded(df: DataFrame, key: str, shards: int) -> DataFrame:
    binary = F.col(f"`{key}`").cast("binary")
    return df.select(F.pmod(F.xxhash64(binary), F.lit(shards)).cast("int").alias("shard"), binary.alias("k"))


def build_shards(df: DataFrame, n: int, key: str = "key", fpp: float = 0.01, seed: int = 0) -> DataFrame:
    """(shard, shards, filter): filters of df's about n distinct keys, dealt by hash so that none has more than BROADCAST_BITS."""
    shards = -(-optimal_bits(n, fpp) // BROADCAST_BITS)
    shape = Bloom.sized(-(-n // shards), fpp, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Bloom] = {}
        for b in batches:
            who, keys = b.column(0).to_numpy(), b.column(1).to_pylist()
            for s in np.unique(who).tolist():
                f = own.setdefault(s, Bloom(shape.bits, shape.hashes, seed))
                f.add(keys[i] for i in np.flatnonzero(who == s))
            for s in [s for s in own if s != int(who[-1])]:  # rows come sorted by shard
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "shards": pa.array([shards], pa.int32()), "filter": pa.array([own.pop(s).to_bytes()], pa.binary())})
        for s, f in own.items():
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "shards": pa.array([shards], pa.int32()), "filter": pa.array([f.to_bytes()], pa.binary())})

    held = _sharded(df, key, shards).where("k IS NOT NULL").distinct().repartition(shards, "shard").sortWithinPartitions("shard")
    return held.mapInArrow(run, "shard int, shards int, filter binary")


def probe_shards(df: DataFrame, filters: DataFrame, key: str = "key") -> DataFrame:
    """(key, might_contain) of df's distinct keys: a shard's filter goes ahead of its keys to the task that has them."""
    shards = filters.agg(F.max("shards")).first()[0] or 1
    kind = df.schema[key].dataType
    asked = _sharded(df, key, shards).where("k IS NOT NULL").distinct().select("shard", F.lit(1).alias("turn"), "k")
    rows = filters.select("shard", F.lit(0).alias("turn"), F.col("filter").alias("k")).unionByName(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for b in batches:
            out: tuple[list, list] = ([], [])
            who, turn, data = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(who) | np.diff(turn)) + 1).tolist(), len(who)]
            for x, y in zip(edges, edges[1:], strict=False):
                if turn[x] == 0:
                    now, own = who[x], Bloom.from_bytes(data[x])
                else:
                    out[0].extend(data[x:y])
                    out[1].extend(own.contains(data[x:y]).tolist() if now == who[x] else [False] * (y - x))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.bool_())], names=["k", "might_contain"])

    found = rows.repartition(shards, "shard").sortWithinPartitions("shard", "turn").mapInArrow(run, "k binary, might_contain boolean")
    return found.select(F.col("k").cast(kind).alias(key), "might_contain")
