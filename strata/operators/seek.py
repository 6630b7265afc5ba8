"""Ordered access: ranges, prefixes, first and last keys, seeks and neighbours.

Seeks are as-of joins.  Instead of a nested loop, targets and keys are sorted together within
at most BUCKETS buckets of the key space: one window over the union carries the last (or next) key
to each target.  Only bucket edges cross buckets, a row each, so the sort is spread over tasks; both
use the same shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def key_range(df: DataFrame, low=None, high=None, key: str = "key") -> DataFrame:
    """Rows with low <= key < high; a bound left None is open.  Both reach the Parquet scan."""
    if low is not None:
        df = df.where(F.col(key) >= F.lit(low))
    return df if high is None else df.where(F.col(key) < F.lit(high))


def prefix_range(df: DataFrame, prefix: str | bytes, key: str = "key") -> DataFrame:
    """Rows whose key starts with prefix, as a key range."""
    data = prefix.encode() if isinstance(prefix, str) else prefix
    end = data.rstrip(b"\xff")
    if isinstance(prefix, str):
        return df.where(F.col(key) >= F.lit(prefix)).where(F.startswith(F.col(key), F.lit(prefix)))
    return key_range(df, data, end[:-1] + bytes([end[-1] + 1]) if end else None, key)


def first_last(df: DataFrame, key: str = "key") -> DataFrame:
    return df.agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"))


#: Ranges into which the key space is cut.
BUCKETS = 64


def _bucket(key: str, edges: list, first: int = 0) -> Column:
    """The number of edges <= key, by binary search: a range partition of the key space."""
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    return F.when(F.col(key) >= F.lit(edges[mid]), _bucket(key, edges[mid + 1 :], first + mid + 1)).otherwise(_bucket(key, edges[:mid], first))


def range_edges(df: DataFrame, key: str = "key", parts: int = 32) -> list:
    """At most parts - 1 keys that cut df into about equal ranges, from a bounded sample."""
    sample = [r[0] for r in df.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(parts * 64).collect()]
    sample = sorted(set(sample))
    return [sample[len(sample) * i // parts] for i in range(1, parts)] if len(sample) >= parts else []


def _cut(rows: DataFrame, keys: DataFrame, key: str, edges: list | None) -> DataFrame:
    """rows (with column k) plus bucket b, dealt by it; of more edges than fit, evenly spaced ones."""
    edges = sorted(set(range_edges(keys, key) if edges is None else edges))
    if len(edges) >= BUCKETS:
        edges = [edges[len(edges) * i // BUCKETS] for i in range(1, BUCKETS)]
    return rows.withColumn("b", _bucket("k", edges)).repartition("b")


def _beyond(cut: DataFrame, shown: Column) -> DataFrame:
    """(b, before, after): the nearest keys in the buckets below and above; a row a bucket."""
    ends = cut.groupBy("b").agg(F.min(shown).alias("lo"), F.max(shown).alias("hi"))
    below, above = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1), W.orderBy("b").rowsBetween(1, W.unboundedFollowing)
    return F.broadcast(ends.select("b", F.max("hi").over(below).alias("before"), F.min("lo").over(above).alias("after")))


def seek(targets: DataFrame, keys: DataFrame, forward: bool = True, target: str = "target", key: str = "key", edges: list | None = None) -> DataFrame:
    """Distinct targets with ``found``: the smallest key >= target, or (not forward) the largest key <= target; else null."""
    own = keys.select(F.col(key).alias("k"), F.lit(True).alias("is_key")).where("k IS NOT NULL").distinct()
    asked = targets.select(F.col(target).alias("k"), F.lit(False).alias("is_key")).where("k IS NOT NULL").distinct()
    both = _cut(own.unionByName(asked), keys, key, edges)
    shown = F.when(F.col("is_key"), F.col("k"))
    order = [F.desc("k") if forward else F.asc("k"), F.desc("is_key")]
    w = W.partitionBy("b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    near = both.withColumn("found", F.last(shown, ignorenulls=True).over(w)).where(~F.col("is_key"))
    found = F.coalesce("found", "after" if forward else "before")
    return near.join(_beyond(both, shown), "b").select(F.col("k").alias(target), found.alias("found"))


def neighbours(keys: DataFrame, key: str = "key", edges: list | None = None) -> DataFrame:
    """Distinct keys with ``prev_key`` and ``next_key``, null at the ends."""
    own = _cut(keys.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct(), keys, key, edges)
    w = W.partitionBy("b").orderBy("k")
    near = own.withColumn("p", F.lag("k").over(w)).withColumn("n", F.lead("k").over(w))
    joined = near.join(_beyond(own, F.col("k")), "b")
    return joined.select(F.col("k").alias(key), F.coalesce("p", "before").alias("prev_key"), F.coalesce("n", "after").alias("next_key"))
