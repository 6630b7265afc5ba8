"""Newest-wins merges, layered lookups and snapshots.

Only predicates on the key may go below a merge: filtering payload or ``deleted`` first would let
older versions resurface.  The functions here keep it that way; Catalyst pushes key predicates
through the aggregate by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "key", seq: str = "seq", method: str = "aggregate") -> DataFrame:
    """The newest entry of every key, tombstones included.

    ``aggregate`` combines on the map side, for logs that overwrite much; ``window`` sorts each
    key's rows once, for keys that are mostly unique.  Rows with equal key and seq must be equal.
    """
    rest = [c for c in log.columns if c not in (key, seq)]
    if method == "window":
        rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(seq), *[F.desc(c) for c in rest]))
        return log.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    if method != "aggregate":
        raise ValueError("method is 'aggregate' or 'window'")
    newest = log.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("__e"))
    return newest.select(*[F.col(c) if c == key else F.col(f"__e.{c}").alias(c) for c in log.columns])


def live(log: DataFrame, key: str = "key", seq: str = "seq", method: str = "aggregate") -> DataFrame:
    """The newest entry of every key that is not deleted."""
    return latest(log, key, seq, method).where(~F.col("deleted"))


def as_of(log: DataFrame, seq_at: int, **kw) -> DataFrame:
    """The live entries as they were right after ``seq_at``."""
    return live(log.where(F.col("seq") <= seq_at), **kw)


def merge_runs(runs: Sequence[DataFrame], drop_tombstones: bool, key: str = "key") -> DataFrame:
    """Newest-first runs merged: of equal keys the first run's entry wins; ``prio`` tells which."""
    layered = None
    for prio, run in enumerate(runs):
        own = run.withColumn("prio", F.lit(prio))
        layered = own if layered is None else layered.unionByName(own)
    return merge_layers(layered, drop_tombstones, key)


def merge_layers(layered: DataFrame, drop_tombstones: bool, key: str = "key") -> DataFrame:
    """As merge_runs, for rows that carry ``prio`` (0 is newest)."""
    rest = [c for c in layered.columns if c not in (key, "prio")]
    first = layered.groupBy(key).agg(F.min_by(F.struct("prio", *rest), "prio").alias("__e"))
    out = first.select(*[F.col(c) if c == key else F.col(f"__e.{c}").alias(c) for c in layered.columns])
    return out.where(~F.col("deleted")) if drop_tombstones else out


def multi_get(probes: DataFrame, view: DataFrame, key: str = "key") -> DataFrame:
    """Every probe row with its key's live entry; nulls where the key is absent or deleted."""
    return probes.join(view, key, "left")
