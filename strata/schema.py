"""Schemas and options of keyed changelogs and their runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Pointer to a separated value.
VREF = T.StructType([
    T.StructField("segment_id", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("value_len", T.LongType()),
    T.StructField("checksum", T.LongType()),
])

#: One operation of the log, or one entry of a run.
ENTRY = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("seq", T.LongType()),
    T.StructField("deleted", T.BooleanType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("vref", VREF),
])

#: One separated value.
BLOB = T.StructType([
    T.StructField("segment_id", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("checksum", T.LongType()),
])

#: A separated value as the table stores it, with the operation that it belongs to.
STORED_BLOB = T.StructType([*BLOB.fields, T.StructField("seq", T.LongType()), T.StructField("value_len", T.LongType())])

#: One run of the manifest.
META = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("smallest", T.BinaryType()),
    T.StructField("largest", T.BinaryType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("created_at", T.LongType()),
])

#: Bytes that a delete counts for, that precede each log record, and that precede each run entry.
TOMBSTONE_BYTES, RECORD_BYTES, ENTRY_BYTES, BLOCK_BYTES = 10, 12, 6, 4096

#: The value that stands for a delete in a binary log, unless the caller names another.
TOMBSTONE = b"\x00strata-x\x01"


@dataclass(frozen=True)
class Options:
    """Knobs of a table; sizes in bytes.

    ``put`` and ``delete`` calls, of any number of threads, are committed in groups of up to ``batch_rows``
    calls.  With ack "sync" a call returns once its group is committed; a group waits for others that are
    on their way, ``write_batch_window_s`` long, and starts ``sync_interval_s`` after the last one at the
    earliest.  With ack "async" a call returns at once, reads of this object see it, and it is committed
    with the call that fills a group or comes ``sync_interval_s`` after its first, or by flush or close.
    """

    memtable_max_bytes: int = 4 << 20
    value_threshold: int = 2 << 10
    segment_max_bytes: int = 64 << 20
    write_batch_window_s: float = 100e-6
    batch_rows: int = 256
    sync_interval_s: float = 0.0
    ack: str = "sync"
    bloom_fpp: float = 0.01

    def __post_init__(self):
        if self.ack not in ("sync", "async"):
            raise ValueError("ack is 'sync' or 'async'")
        for name in ("memtable_max_bytes", "segment_max_bytes"):
            if getattr(self, name) <= 0:
                object.__setattr__(self, name, type(self).__dataclass_fields__[name].default)
        if self.write_batch_window_s < 0:
            object.__setattr__(self, "write_batch_window_s", 0.0)

    @property
    def target_file_bytes(self) -> int:
        """Size at which compaction closes an output."""
        return max(self.memtable_max_bytes, 4 << 20)
