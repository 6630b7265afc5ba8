"""Run metadata: bounds, recency, overlap, islands, and what to look up where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bounds(entries: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """Smallest and largest key, and rows, of each run."""
    return entries.groupBy(*by).agg(F.min(key).alias("smallest"), F.max(key).alias("largest"), F.count("*").alias("n_entries"))


def level_groups(meta: DataFrame) -> DataFrame:
    """Per level: its runs and bytes, and its key bounds."""
    return meta.groupBy("level").agg(
        F.count("*").alias("n_runs"), F.sum("size_bytes").cast("bigint").alias("size_bytes"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest")
    )


def recency(meta: DataFrame, out: str = "rank") -> DataFrame:
    """meta plus each run's place in its level: newest first at level 0, by smallest key elsewhere."""
    zero = F.col("level") == 0
    w = W.partitionBy("level").orderBy(
        F.when(zero, -F.col("created_at")), F.when(~zero, F.col("smallest")), F.when(~zero, F.col("created_at")),
        F.desc(F.when(zero, F.col("filename"))), F.when(~zero, F.col("filename")),
    )
    return meta.withColumn(out, F.row_number().over(w))


def islands(meta: DataFrame, by: list[str] | None = None, out: str = "island") -> DataFrame:
    """meta plus a number that runs share when a chain of overlapping key ranges joins them; touching counts."""
    keys = by or []
    w = W.partitionBy(*keys).orderBy("smallest", "largest", "filename")
    before = F.max("largest").over(w.rowsBetween(W.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("smallest") > before), 1).otherwise(0)
    return meta.withColumn("__starts", starts).withColumn(out, F.sum("__starts").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("bigint")).drop("__starts")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_file, b_file) of runs whose closed key ranges meet.

    An interval join as two range conditions; metadata has a row per file, so the session's
    broadcast threshold decides how it runs.
    """
    x = a.select(F.col("filename").alias("a_file"), F.col("smallest").alias("a_lo"), F.col("largest").alias("a_hi"))
    y = b.select(F.col("filename").alias("b_file"), F.col("smallest").alias("b_lo"), F.col("largest").alias("b_hi"))
    return x.join(y, (F.col("a_hi") >= F.col("b_lo")) & (F.col("a_lo") <= F.col("b_hi"))).select("a_file", "b_file")


def candidates(keys: DataFrame, meta: DataFrame, key: str = "key") -> DataFrame:
    """(key, filename, level) of runs whose bounds hold the key."""
    m = meta.select("filename", "level", "smallest", "largest")
    return keys.select(key).distinct().join(m, (F.col(key) >= F.col("smallest")) & (F.col(key) <= F.col("largest"))).select(key, "filename", "level")


def replace_runs(meta: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The manifest without removed runs (by filename), unless they are added again, and with the added ones."""
    gone = removed.select("filename").join(added.select("filename"), "filename", "left_anti")
    kept = meta.join(gone, "filename", "left_anti").join(added.select("filename"), "filename", "left_anti")
    return kept.unionByName(added)


def plan_compaction(meta: DataFrame) -> DataFrame:
    """meta's rows that the next compaction reads, plus ``role`` (source or target), ``target_level`` and ``drop_tombstones``.

    Sources are the level-0 runs chained to the oldest one by overlap, targets the level-1 runs that
    overlap their hull.  Without level-0 runs there is nothing to do.
    """
    zero = islands(meta.where("level = 0"))
    oldest = zero.orderBy("created_at", "filename").limit(1).select(F.col("island").alias("__i"))
    source = zero.join(F.broadcast(oldest), F.col("island") == F.col("__i")).drop("island", "__i")  # one row
    hull = source.agg(F.min("smallest").alias("__lo"), F.max("largest").alias("__hi"))
    target = meta.where("level = 1").join(F.broadcast(hull), (F.col("largest") >= F.col("__lo")) & (F.col("smallest") <= F.col("__hi"))).drop("__lo", "__hi")
    deepest = meta.agg((F.coalesce(F.max("level"), F.lit(0)) <= 1).alias("drop_tombstones"))
    picked = source.withColumn("role", F.lit("source")).unionByName(target.withColumn("role", F.lit("target")))
    return picked.withColumn("target_level", F.lit(1)).join(F.broadcast(deepest), F.lit(True))  # one row
