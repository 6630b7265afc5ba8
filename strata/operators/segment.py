"""Size-based segmentation of ordered rows, and offsets within segments.

Every rule here resets a running size at a boundary that depends on the size so far, so a stream
is sequential by nature.  It is cut into independent streams where there is a natural one (a run, a
log shard), each handled by one Arrow batch iterator that holds a batch at a time, not the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Closes a segment after the row that fills it (memtables, merge outputs, rewritten runs).
AFTER = "after"
#: Starts a segment before the row that would overfill it, unless the segment is empty (blocks, value segments).
BEFORE = "before"


def cut_sizes(sizes: np.ndarray, held: int, limit: int, rule: str) -> tuple[np.ndarray, int, int]:
    """Segment numbers, from 0, of rows of these sizes after a segment that holds so much already; the number that goes on, and what it holds.

    A search in the running sums finds each segment's end, so the work in Python is one step a segment.
    """
    n, sums, out, number, start = len(sizes), np.cumsum(sizes), np.zeros(len(sizes), np.int64), 0, 0
    while start < n:
        base = (int(sums[start - 1]) if start else 0) - held  # sums[j] - base: what the segment holds with row j
        if rule == AFTER:
            end = max(int(np.searchsorted(sums, base + limit, "left")) + 1, start + 1)
            full = end <= n and int(sums[end - 1]) - base >= limit
        else:
            end = max(int(np.searchsorted(sums, base + limit, "right")), start)
            before = int(sums[end - 1]) - base if end > start else held
            end += end < n and before <= 0  # a row too large for any segment has one of its own
            full = end < n
        end = min(end, n)
        out[start:end] = number
        held = 0 if full else int(sums[n - 1]) - base
        number, start = number + int(full), end
    return out, number, held


def numbered(held: DataFrame, size: str, limit: int, rule: str, out: str, who: int | None = None) -> DataFrame:
    """held plus its segment's number, from 0, of each task's rows as they come, anew where column ``who`` changes."""
    at = held.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, held_bytes = object(), 0, 0
        for b in batches:
            sizes, ids = b.column(at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.zeros(len(b), np.int64)
            stream = np.zeros(len(b), np.int64) if who is None else b.column(who).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(stream)) + 1).tolist(), len(b)] if len(b) else []
            for x, y in zip(edges, edges[1:], strict=False):
                name = None if who is None else b.column(who)[x].as_py()
                if name != now:
                    now, number, held_bytes = name, 0, 0
                own, more, held_bytes = cut_sizes(sizes[x:y], held_bytes, limit, rule)
                ids[x:y] = own + number
                number += more
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64())], names=[*b.schema.names, out])

    return held.mapInArrow(run, T.StructType([*held.schema.fields, T.StructField(out, T.LongType())]))


def segments(df: DataFrame, size: str, limit: int, rule: str, order: list[str], by: str | None = None, out: str = "segment") -> DataFrame:
    """df plus its segment's number, from 0, within each stream ``by`` (one stream if None).

    Rows of a stream are taken in ``order``, which must be total.
    """
    if rule not in (AFTER, BEFORE):
        raise ValueError("rule is AFTER or BEFORE")
    stream = F.col(by) if by else F.lit(0)
    held = df.withColumn("__stream", stream)
    held = held.repartition("__stream") if by else held.coalesce(1)
    held = held.sortWithinPartitions("__stream", *order)
    return numbered(held, size, limit, rule, out, held.columns.index("__stream")).drop("__stream")


def offsets(df: DataFrame, size: str, segment: str, order: list[str], out: str = "offset") -> DataFrame:
    """df plus the sum of the sizes before each row in its segment."""
    w = W.partitionBy(segment).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))
