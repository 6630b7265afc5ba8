"""Structured Streaming: a sink that commits micro-batches, and keyed state that is the live view."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from strata.table import KVTable


def upsert_stream(ops: DataFrame, table: KVTable, checkpoint: str, name: str = "upserts", available_now: bool = True) -> StreamingQuery:
    """Writes a stream of (key, seq, deleted, value) to the table, a commit a micro-batch.

    The manifest records the last batch of each query name, so a batch run again after a crash
    commits nothing twice; late rows with a lower seq lose in the merge.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        if not df.isEmpty():
            table.refresh().write(df, name, batch_id)

    writer = ops.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class _Newest(StatefulProcessor):
    """Per key, the entry with the highest seq."""

    def init(self, handle) -> None:
        self._held = handle.getValueState("newest", "seq bigint, deleted boolean, value binary")

    def handleInputRows(self, key, rows, timerValues):
        now = self._held.get() if self._held.exists() else None
        best = now
        for pdf in rows:
            for seq, deleted, value in zip(pdf["seq"], pdf["deleted"], pdf["value"], strict=True):
                if best is None or seq > best[0]:
                    best = (int(seq), bool(deleted), value)
        if best is not now:
            self._held.update(best)
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "deleted": [best[1]], "value": [best[2]]})

    def close(self) -> None:
        pass


def latest_changes(ops: DataFrame) -> DataFrame:
    """A stream of a key's newest entry each time it changes; needs the RocksDB state store provider."""
    return ops.groupBy("key").transformWithStateInPandas(
        _Newest(), outputStructType="key binary, seq bigint, deleted boolean, value binary", outputMode="Update", timeMode="None"
    )
