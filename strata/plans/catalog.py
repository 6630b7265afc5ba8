"""name -> (query, DuckDB SQL or None).  Operation logs are derived from the driver's tables:

* ``events``: key user_id, seq event_id, deleted where event_type is 'error', eight log shards by user;
* ``orders``: key o_custkey, seq o_orderkey, deleted where o_orderstatus is 'F';
* ``documents``: key doc_id, value the text;
* run metadata from ``supplier``: a closed key range, level and age per row.

Queries kv_* write the log to a table in the shared folder, in several commits, and answer from that
table after maintenance; each call starts a new table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.functions import bloom, sizes
from strata.operators import merge, metadata, seek, segment, values
from strata.schema import Options
from strata.sources import formats
from strata.sources.manifest import Store
from strata.streaming import upsert_stream
from strata.table import KVTable

SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(c, width: int = 8) -> Column:
    return F.lpad((c if isinstance(c, Column) else F.col(c)).cast("string"), width, "0")


def events_log(spark, d) -> DataFrame:
    e = _table(spark, d, "events")
    return e.select(
        _padded("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"),
        F.concat("event_type", F.lit("|"), "props").alias("value"), F.pmod("user_id", F.lit(SHARDS)).alias("shard"),
    )


EV = (
    "ev AS (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_id AS seq, event_type = 'error' AS deleted, "
    f"event_type || '|' || props AS value, user_id % {SHARDS} AS shard FROM events), "
    "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ev) WHERE rn = 1), "
    "live AS (SELECT key, seq, value FROM newest WHERE NOT deleted)"
)


def orders_log(spark, d) -> DataFrame:
    o = _table(spark, d, "orders")
    return o.select(_padded("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "F").alias("deleted"), F.col("o_orderpriority").alias("value"))


OR = (
    "ol AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS key, o_orderkey AS seq, o_orderstatus = 'F' AS deleted, o_orderpriority AS value FROM orders)"
)


def docs_log(spark, d) -> DataFrame:
    return _table(spark, d, "documents").select(
        _padded("doc_id", 16).cast("binary").alias("key"), F.col("doc_id").alias("seq"), F.lit(False).alias("deleted"),
        F.col("text").cast("binary").alias("value"), F.pmod("doc_id", F.lit(4)).cast("int").alias("shard"),
    )


DOCS = "dl AS (SELECT lpad(CAST(doc_id AS VARCHAR), 16, '0') AS key, doc_id AS seq, text AS value, strlen(text) AS n, doc_id % 4 AS shard FROM documents)"


def runs_meta(spark, d) -> DataFrame:
    s, lo = _table(spark, d, "supplier"), F.pmod(F.col("s_suppkey") * 37, F.lit(1009)) * 10
    return s.select(
        F.concat(_padded("s_suppkey"), F.lit(".sst")).alias("filename"), F.when(F.col("s_nationkey") % 3 == 0, 0).otherwise(1).alias("level"),
        _padded(lo).alias("smallest"), _padded(lo + F.col("s_nationkey") * 10).alias("largest"),
        (F.col("s_nationkey") * 100 + 7).cast("bigint").alias("size_bytes"), F.col("s_suppkey").alias("created_at"),
    )


RM = (
    "rm AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '.sst' AS filename, CASE WHEN s_nationkey % 3 = 0 THEN 0 ELSE 1 END AS level, "
    "lpad(CAST(s_suppkey * 37 % 1009 * 10 AS VARCHAR), 8, '0') AS smallest, lpad(CAST(s_suppkey * 37 % 1009 * 10 + s_nationkey * 10 AS VARCHAR), 8, '0') AS largest, "
    "CAST(s_nationkey * 100 + 7 AS BIGINT) AS size_bytes, s_suppkey AS created_at FROM supplier)"
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Merges and lookups


@query(f"WITH {EV} SELECT key, seq, value FROM live")
def live_view(spark, d):
    return merge.live(events_log(spark, d).drop("shard")).select("key", "seq", "value")


@query(f"WITH {EV} SELECT key, seq, value FROM live")
def live_view_window(spark, d):
    return merge.live(events_log(spark, d).drop("shard"), method="window").select("key", "seq", "value")


@query(f"WITH {OR} SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ol) WHERE rn = 1 AND NOT deleted")
def live_view_orders(spark, d):
    return merge.live(orders_log(spark, d)).select("key", "seq", "value")


@query(f"WITH {EV} SELECT key, count(*) FILTER (NOT deleted) AS n_puts, count(*) FILTER (deleted) AS n_deletes FROM ev GROUP BY key")
def op_counts(spark, d):
    return events_log(spark, d).groupBy("key").agg(F.count_if(~F.col("deleted")).alias("n_puts"), F.count_if("deleted").alias("n_deletes"))


@query(f"WITH {EV} SELECT key, seq FROM newest WHERE deleted")
def tombstoned_keys(spark, d):
    return merge.latest(events_log(spark, d).drop("shard", "value")).where("deleted").select("key", "seq")


@query(f"WITH {EV} SELECT count(*) AS n_ops, count(DISTINCT key) AS n_keys FROM ev")
def key_counts(spark, d):
    return events_log(spark, d).agg(F.count("*").alias("n_ops"), F.countDistinct("key").alias("n_keys"))


@query(f"WITH {EV}, p AS (SELECT lpad(CAST(i AS VARCHAR), 8, '0') AS key FROM range(400) t(i)) SELECT key, seq, value FROM p LEFT JOIN live USING (key)")
def multi_get(spark, d):
    probes = spark.range(400).select(_padded("id").alias("key"))
    return merge.multi_get(probes, merge.live(events_log(spark, d).drop("shard")).select("key", "seq", "value"))


@query(f"WITH {EV} SELECT key, seq, value FROM live WHERE key = '00000042'")
def point_get(spark, d):
    return merge.live(events_log(spark, d).drop("shard").where("key = '00000042'")).select("key", "seq", "value")


_LAYER = "CASE WHEN seq >= 7500 THEN 0 WHEN seq >= 5000 THEN 1 WHEN seq >= 2500 THEN 2 ELSE 3 END"
_LAYERED = (
    f"ly AS (SELECT key, seq, deleted, value, {_LAYER} AS prio FROM ev), lr AS (SELECT key, max(seq) AS seq, prio FROM ly GROUP BY key, prio), "
    "lm AS (SELECT key, min(prio) AS prio FROM lr GROUP BY key), "
    "won AS (SELECT ly.key, ly.prio, ly.seq, ly.deleted, ly.value FROM lm JOIN lr USING (key, prio) JOIN ly USING (key, prio, seq))"
)


def _layers(spark, d) -> list[DataFrame]:
    ev = events_log(spark, d).drop("shard")
    cuts = [("seq >= 7500"), ("seq >= 5000 AND seq < 7500"), ("seq >= 2500 AND seq < 5000"), ("seq < 2500")]
    return [merge.latest(ev.where(c)) for c in cuts]


@query(f"WITH {EV}, {_LAYERED} SELECT key, prio, seq, deleted, CASE WHEN NOT deleted THEN value END AS value FROM won")
def get_priority_layers(spark, d):
    won = merge.merge_runs(_layers(spark, d), drop_tombstones=False)
    return won.select("key", "prio", "seq", "deleted", F.when(~F.col("deleted"), F.col("value")).alias("value"))


@query(f"WITH {EV}, {_LAYERED} SELECT key, seq, value FROM won WHERE NOT deleted")
def merge_with_tombstone_drop(spark, d):
    return merge.merge_runs(_layers(spark, d), drop_tombstones=True).select("key", "seq", "value")


@query(f"WITH {EV}, {_LAYERED} SELECT key, seq, deleted FROM won")
def merge_keep_tombstones(spark, d):
    return merge.merge_runs(_layers(spark, d), drop_tombstones=False).select("key", "seq", "deleted")


@query(
    f"WITH {EV}, s AS (SELECT unnest([1000, 5000, 9000]) AS at_seq), x AS (SELECT at_seq, ev.*, row_number() OVER (PARTITION BY at_seq, key ORDER BY seq DESC) AS rn "
    "FROM ev JOIN s ON ev.seq <= at_seq) SELECT CAST(at_seq AS INTEGER) AS at_seq, key, seq FROM x WHERE rn = 1 AND NOT deleted"
)
def snapshot_at_seq(spark, d):
    log, out = events_log(spark, d).drop("shard", "value"), None
    for at in (1000, 5000, 9000):
        own = merge.as_of(log, at).select(F.lit(at).alias("at_seq"), "key", "seq")
        out = own if out is None else out.unionByName(own)
    return out


# Ordered access


@query(f"WITH {EV} SELECT key, seq, value FROM live WHERE key >= '00000020' AND key < '00000060'")
def range_scan(spark, d):
    return seek.key_range(merge.live(events_log(spark, d).drop("shard")), "00000020", "00000060").select("key", "seq", "value")


@query(f"WITH {EV} SELECT key, seq FROM live WHERE key LIKE '0000001%'")
def prefix_scan(spark, d):
    return seek.prefix_range(merge.live(events_log(spark, d).drop("shard")), "0000001").select("key", "seq")


@query(f"WITH {EV} SELECT key, seq FROM live ORDER BY key DESC LIMIT 10")
def reverse_scan_topk(spark, d):
    return merge.live(events_log(spark, d).drop("shard", "value")).select("key", "seq").orderBy(F.desc("key")).limit(10)


@query(f"WITH {EV} SELECT min(key) AS first_key, max(key) AS last_key FROM live")
def first_last_key(spark, d):
    return seek.first_last(merge.live(events_log(spark, d).drop("shard", "value")))


_TARGETS = "tg AS (SELECT lpad(CAST(i AS VARCHAR), 8, '0') || 'x' AS target FROM range(0, 200, 3) t(i))"


def _targets(spark):
    return spark.range(0, 200, 3).select(F.concat(_padded("id"), F.lit("x")).alias("target"))


@query(f"WITH {EV}, {_TARGETS} SELECT target, (SELECT min(key) FROM live WHERE key >= target) AS found FROM tg")
def seek_ge(spark, d):
    return seek.seek(_targets(spark), merge.live(events_log(spark, d).drop("shard", "value")))


@query(f"WITH {EV}, {_TARGETS} SELECT target, (SELECT max(key) FROM live WHERE key <= target) AS found FROM tg")
def seek_le(spark, d):
    return seek.seek(_targets(spark), merge.live(events_log(spark, d).drop("shard", "value")), forward=False)


@query(f"WITH {EV} SELECT key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM live")
def neighbours(spark, d):
    return seek.neighbours(merge.live(events_log(spark, d).drop("shard", "value")))


# Segmentation


def _segments_sql(source: str, limit: int, rule: str) -> str:
    """seg(stream, rn, seg) over source(stream, rn, n), rn from 1."""
    if rule == segment.AFTER:
        new, acc = "CASE WHEN r.acc >= {0} THEN 1 ELSE 0 END", "CASE WHEN r.acc >= {0} THEN 0 ELSE r.acc END + s.n"
    else:
        new, acc = "CASE WHEN r.acc > 0 AND r.acc + s.n > {0} THEN 1 ELSE 0 END", "CASE WHEN r.acc > 0 AND r.acc + s.n > {0} THEN 0 ELSE r.acc END + s.n"
    return (
        f"seg AS (SELECT stream, rn, CAST(0 AS BIGINT) AS seg, CAST(n AS BIGINT) AS acc FROM {source} WHERE rn = 1 UNION ALL "
        f"SELECT s.stream, s.rn, r.seg + {new.format(limit)}, CAST({acc.format(limit)} AS BIGINT) FROM seg r JOIN {source} s ON s.stream = r.stream AND s.rn = r.rn + 1)"
    )


_BYTES = "strlen(key) + CASE WHEN deleted THEN 10 ELSE strlen(value) END"


@query(
    f"WITH RECURSIVE {EV}, src AS MATERIALIZED (SELECT shard AS stream, seq, row_number() OVER (PARTITION BY shard ORDER BY seq) AS rn, {_BYTES} AS n FROM ev), "
    f"{_segments_sql('src', 4096, segment.AFTER)} SELECT stream AS shard, seg AS segment, count(*) AS n_ops, min(seq) AS first_seq, max(seq) AS last_seq, "
    "CAST(sum(n) AS BIGINT) AS n_bytes FROM seg JOIN src USING (stream, rn) GROUP BY ALL"
)
def memtable_rotation(spark, d):
    log = events_log(spark, d).withColumn("n", sizes.logical_bytes())
    cut = segment.segments(log, "n", 4096, segment.AFTER, ["seq"], by="shard")
    return cut.groupBy("shard", "segment").agg(F.count("*").alias("n_ops"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("n").alias("n_bytes"))


@query(
    f"WITH RECURSIVE {EV}, src AS MATERIALIZED (SELECT shard AS stream, key, seq, row_number() OVER (PARTITION BY shard ORDER BY key, seq) AS rn, 6 + strlen(key) + strlen(value) AS n FROM ev), "
    f"{_segments_sql('src', 4096, segment.BEFORE)} SELECT stream AS shard, seg AS block, min(key) AS first_key, count(*) AS n_entries, CAST(sum(n) AS BIGINT) AS n_bytes "
    "FROM seg JOIN src USING (stream, rn) GROUP BY ALL"
)
def block_packing(spark, d):
    log = events_log(spark, d).withColumn("n", (F.lit(6) + F.octet_length("key") + F.octet_length("value")).cast("bigint"))
    cut = segment.segments(log, "n", 4096, segment.BEFORE, ["key", "seq"], by="shard", out="block")
    return cut.groupBy("shard", "block").agg(F.min("key").alias("first_key"), F.count("*").alias("n_entries"), F.sum("n").alias("n_bytes"))


@query(
    f"WITH RECURSIVE {EV}, src AS MATERIALIZED (SELECT shard AS stream, key, row_number() OVER (PARTITION BY shard ORDER BY key) AS rn, strlen(key) + strlen(value) AS n FROM newest WHERE NOT deleted), "
    f"{_segments_sql('src', 512, segment.AFTER)} SELECT stream AS shard, seg AS output, min(key) AS smallest, max(key) AS largest, count(*) AS n_keys FROM seg JOIN src USING (stream, rn) GROUP BY ALL"
)
def compaction_split(spark, d):
    log = merge.live(events_log(spark, d)).withColumn("n", (F.octet_length("key") + F.octet_length("value")).cast("bigint"))
    cut = segment.segments(log, "n", 512, segment.AFTER, ["key"], by="shard", out="output")
    return cut.groupBy("shard", "output").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count("*").alias("n_keys"))


_VLOG = (
    f"{DOCS}, src AS MATERIALIZED (SELECT shard AS stream, key, n AS len, row_number() OVER (PARTITION BY shard ORDER BY seq) AS rn, 12 + 16 + n AS n FROM dl WHERE n > 2048), "
    f"{_segments_sql('src', 65536, segment.BEFORE)}, vl AS (SELECT stream, key, len, 1 + seg + stream * 4294967296 AS segment_id, "
    "CAST(sum(n) OVER (PARTITION BY stream, seg ORDER BY rn) - n AS BIGINT) AS \"offset\" FROM seg JOIN src USING (stream, rn))"
)


@query(f'WITH RECURSIVE {_VLOG} SELECT key, CAST(segment_id AS BIGINT) AS segment_id, "offset", CAST(len AS BIGINT) AS value_len FROM vl')
def vlog_offsets(spark, d):
    near, _ = values.separate(docs_log(spark, d), 2048, 65536, by="shard")
    far = near.where("vref IS NOT NULL")
    return far.select(F.col("key").cast("string").alias("key"), "vref.segment_id", "vref.offset", "vref.value_len")


# Values


@query(f"WITH {DOCS} SELECT n > 2048 AS separate, count(*) AS n_values, CAST(sum(n) AS BIGINT) AS n_bytes FROM dl GROUP BY ALL")
def value_placement(spark, d):
    placed = values.placement(docs_log(spark, d), 2048)
    return placed.groupBy("separate").agg(F.count("*").alias("n_values"), F.sum("n_bytes").alias("n_bytes"))


@query(f"WITH {DOCS}, t AS (SELECT unnest([128, 256, 512, 1024, 2048]) AS threshold) SELECT threshold, count(*) FILTER (n > threshold) AS n_separate, CAST(coalesce(sum(n) FILTER (n <= threshold), 0) AS BIGINT) AS inline_bytes FROM dl, t GROUP BY ALL")
def threshold_sweep(spark, d):
    n = values.placement(docs_log(spark, d), 0).select("n_bytes").withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (128, 256, 512, 1024, 2048)])))
    over = F.col("n_bytes") > F.col("threshold")
    return n.groupBy("threshold").agg(F.count_if(over).alias("n_separate"), F.coalesce(F.sum(F.when(~over, F.col("n_bytes"))), F.lit(0)).alias("inline_bytes"))


@query(f"WITH {DOCS} SELECT key, md5(value) AS value_md5, CAST(n AS BIGINT) AS n_bytes FROM dl")
def value_deref(spark, d):
    found = values.resolve(*values.separate(docs_log(spark, d), 2048, 1 << 20, by="shard"))
    return found.select(F.col("key").cast("string").alias("key"), F.md5("value").alias("value_md5"), F.octet_length("value").cast("bigint").alias("n_bytes"))


@query(f"WITH {DOCS} SELECT count(*) AS n_blobs, count(*) FILTER (seq % 5 = 0) AS n_damaged FROM dl WHERE n > 2048")
def integrity_check(spark, d):
    """Every fifth document's blob has a byte too many."""
    log = docs_log(spark, d)
    _, blobs = values.separate(log, 2048, 1 << 20, by="shard")
    hurt = F.col("key").cast("string").cast("bigint") % 5 == 0
    blobs = blobs.withColumn("value", F.when(hurt, F.concat("value", F.lit(b"!"))).otherwise(F.col("value")))
    return blobs.agg(F.count("*").alias("n_blobs")).join(F.broadcast(values.damaged(blobs).agg(F.count("*").alias("n_damaged"))), F.lit(True))  # one row


def _order_refs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as entries that refer to a blob each: segment o_orderkey div 1000, offset o_orderkey."""
    log = orders_log(spark, d).withColumn("vref", F.struct(F.floor(F.col("seq") / 1000).alias("segment_id"), F.col("seq").alias("offset")))
    blobs = log.where("NOT deleted").select("vref.segment_id", "vref.offset", F.octet_length("value").alias("n"))
    return merge.live(log), blobs


@query(
    f"WITH {OR}, lv AS (SELECT seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ol) WHERE rn = 1 AND NOT deleted) "
    "SELECT CAST(seq // 1000 AS BIGINT) AS segment_id, count(*) AS n_garbage, CAST(sum(strlen(value)) AS BIGINT) AS garbage_bytes FROM ol WHERE NOT deleted AND seq NOT IN (SELECT seq FROM lv) GROUP BY ALL"
)
def garbage_by_segment(spark, d):
    live, blobs = _order_refs(spark, d)
    return values.garbage(blobs, live).groupBy("segment_id").agg(F.count("*").alias("n_garbage"), F.sum("n").alias("garbage_bytes"))


@query(
    f"WITH {OR} SELECT CAST(seq // 1000 AS BIGINT) AS segment_id, count(*) AS n_dangling FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ol) "
    "WHERE rn = 1 AND NOT deleted AND (seq // 1000) % 4 = 0 GROUP BY ALL"
)
def dangling_refs(spark, d):
    """Every fourth segment is lost."""
    live, blobs = _order_refs(spark, d)
    held = blobs.where("segment_id % 4 <> 0")
    return live.select("vref.*").join(held, ["segment_id", "offset"], "left_anti").groupBy("segment_id").agg(F.count("*").alias("n_dangling"))


@query(f"WITH {EV} SELECT key, seq, strlen(value) > 40 AS separate FROM live")
def gc_live_rewrite(spark, d):
    live = merge.live(events_log(spark, d).drop("shard"))
    return values.placement(live, 40).select("key", "seq", "separate")


# Runs and manifests

_RUNS = f"{OR}, rn AS (SELECT CAST(seq // 500 AS BIGINT) AS run, * FROM ol)"


def _runs(spark, d):
    return orders_log(spark, d).withColumn("run", F.floor(F.col("seq") / 500))


@query(f"WITH {_RUNS} SELECT run, min(key) AS smallest, max(key) AS largest, count(*) AS n_entries FROM rn GROUP BY run")
def run_bounds(spark, d):
    return metadata.bounds(_runs(spark, d), ["run"])


@query(f"WITH {_RUNS} SELECT run % 4 AS run_set, min(key) AS smallest, max(key) AS largest, count(*) AS n_entries FROM rn GROUP BY ALL")
def bounds_of_set(spark, d):
    return metadata.bounds(_runs(spark, d).withColumn("run_set", F.col("run") % 4), ["run_set"])


@query(f"WITH {_RUNS} SELECT CAST(run AS VARCHAR) AS filename, CAST(0 AS INTEGER) AS level, min(key) AS smallest, max(key) AS largest FROM rn GROUP BY run")
def manifest_rebuild(spark, d):
    return metadata.bounds(_runs(spark, d), ["run"]).select(F.col("run").cast("string").alias("filename"), F.lit(0).alias("level"), "smallest", "largest")


@query(f"WITH {RM} SELECT level, count(*) AS n_runs, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, min(smallest) AS smallest, max(largest) AS largest FROM rm GROUP BY level")
def level_groups(spark, d):
    return metadata.level_groups(runs_meta(spark, d))


@query(
    f"WITH {RM} SELECT filename, level, CAST(row_number() OVER (PARTITION BY level ORDER BY CASE WHEN level = 0 THEN -created_at END, CASE WHEN level > 0 THEN smallest END, "
    "created_at, filename) AS INTEGER) AS rank FROM rm"
)
def recency_rank(spark, d):
    return metadata.recency(runs_meta(spark, d)).select("filename", "level", "rank")


_ISLANDS = (
    "il AS (SELECT *, sum(st) OVER (PARTITION BY level ORDER BY smallest, largest, filename ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN smallest > "
    "max(largest) OVER (PARTITION BY level ORDER BY smallest, largest, filename ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS st FROM rm))"
)


@query(f"WITH {RM}, {_ISLANDS} SELECT filename, level, CAST(island AS BIGINT) AS island FROM il")
def overlap_islands(spark, d):
    return metadata.islands(runs_meta(spark, d), ["level"]).select("filename", "level", "island")


_PLAN = (
    f"{_ISLANDS}, so AS (SELECT * FROM il WHERE level = 0 AND island = (SELECT island FROM il WHERE level = 0 ORDER BY created_at, filename LIMIT 1)), "
    "ta AS (SELECT rm.* FROM rm, (SELECT min(smallest) AS lo, max(largest) AS hi FROM so) h WHERE level = 1 AND rm.largest >= lo AND rm.smallest <= hi)"
)


@query(
    f"WITH {RM}, {_PLAN} SELECT filename, 'source' AS role, CAST(1 AS INTEGER) AS target_level, TRUE AS drop_tombstones FROM so UNION ALL "
    "SELECT filename, 'target', CAST(1 AS INTEGER), TRUE FROM ta"
)
def compaction_plan(spark, d):
    return metadata.plan_compaction(runs_meta(spark, d)).select("filename", "role", "target_level", "drop_tombstones")


@query(f"WITH {RM}, {_PLAN} SELECT filename FROM so")
def l0_closure(spark, d):
    return metadata.plan_compaction(runs_meta(spark, d)).where("role = 'source'").select("filename")


@query(f"WITH {RM} SELECT a.filename AS a_file, b.filename AS b_file FROM rm a JOIN rm b ON a.level = 0 AND b.level = 1 AND a.largest >= b.smallest AND a.smallest <= b.largest")
def overlap_targets(spark, d):
    m = runs_meta(spark, d)
    return metadata.overlaps(m.where("level = 0"), m.where("level = 1"))


_KEYS = "kk AS (SELECT lpad(CAST(i AS VARCHAR), 8, '0') AS key FROM range(0, 11000, 250) t(i))"


@query(f"WITH {RM}, {_KEYS} SELECT key, filename, level FROM kk JOIN rm ON key BETWEEN smallest AND largest")
def key_to_run(spark, d):
    return metadata.candidates(spark.range(0, 11000, 250).select(_padded("id").alias("key")), runs_meta(spark, d))


@query(f"WITH {RM}, {_KEYS} SELECT key AS target, (SELECT max(smallest) FROM rm WHERE smallest <= key) AS found FROM kk")
def block_index_lookup(spark, d):
    keys = spark.range(0, 11000, 250).select(_padded("id").alias("target"))
    return seek.seek(keys, runs_meta(spark, d), forward=False, key="smallest")


@query(
    f"WITH {RM}, gone AS (SELECT filename FROM rm WHERE created_at % 3 = 0), new AS (SELECT filename, 1 AS level, smallest, largest, size_bytes * 2 AS size_bytes, created_at FROM rm WHERE created_at % 6 = 0) "
    "SELECT filename, CAST(level AS INTEGER) AS level, size_bytes FROM rm WHERE filename NOT IN (SELECT filename FROM gone) UNION ALL SELECT filename, CAST(level AS INTEGER), size_bytes FROM new"
)
def manifest_replace(spark, d):
    m = runs_meta(spark, d)
    added = m.where("created_at % 6 = 0").withColumn("level", F.lit(1)).withColumn("size_bytes", F.col("size_bytes") * 2)
    return metadata.replace_runs(m, m.where("created_at % 3 = 0"), added).select("filename", "level", "size_bytes")


# Logs and sketches


@query(
    "WITH r AS (SELECT event_id // 1000 AS log, event_id AS pos, (event_id % 997) <> 0 OR event_id = 0 AS ok FROM events), b AS (SELECT log, min(pos) AS bad FROM r WHERE NOT ok GROUP BY log) "
    "SELECT CAST(r.log AS BIGINT) AS log, count(*) AS n_valid, max(pos) AS last_pos FROM r LEFT JOIN b ON r.log = b.log WHERE bad IS NULL OR pos < bad GROUP BY r.log"
)
def wal_torn_tail(spark, d):
    ok = (F.col("event_id") % 997 != 0) | (F.col("event_id") == 0)
    r = _table(spark, d, "events").select(F.floor(F.col("event_id") / 1000).alias("log"), F.col("event_id").alias("pos"), ok.alias("ok"))
    return values.valid_prefix(r, "log").groupBy("log").agg(F.count("*").alias("n_valid"), F.max("pos").alias("last_pos"))


_BATCH = (
    f"e AS (SELECT user_id % {SHARDS} AS shard, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % {SHARDS} ORDER BY event_id) <= INTERVAL 600 SECOND THEN 0 ELSE 1 END AS st FROM events), "
    "i AS (SELECT *, sum(st) OVER (PARTITION BY shard ORDER BY event_id) AS isl FROM e), "
    "n AS (SELECT *, (row_number() OVER (PARTITION BY shard, isl ORDER BY event_id) - 1) // 256 AS part FROM i)"
)


@query(f"WITH {_BATCH} SELECT shard, CAST(isl AS BIGINT) AS window_no, CAST(part AS BIGINT) AS part, count(*) AS n_ops, min(event_id) AS first_seq FROM n GROUP BY ALL")
def group_commit_batches(spark, d):
    w = W.partitionBy("shard").orderBy("event_id")
    e = _table(spark, d, "events").select(F.pmod("user_id", F.lit(SHARDS)).alias("shard"), "event_id", "ts")
    gap = F.col("ts") <= F.lag("ts").over(w) + F.expr("INTERVAL 600 SECOND")
    e = e.withColumn("window_no", F.sum(F.when(gap, 0).otherwise(1)).over(w))
    place = F.row_number().over(W.partitionBy("shard", "window_no").orderBy("event_id")) - 1
    return e.withColumn("part", F.floor(place / 256)).groupBy("shard", "window_no", "part").agg(F.count("*").alias("n_ops"), F.min("event_id").alias("first_seq"))


@query(
    f"WITH {_RUNS}, c AS (SELECT run, count(DISTINCT key) AS n FROM rn GROUP BY run), b AS (SELECT *, greatest(64, CAST(ceil(ceil(n * -ln(0.01) / (ln(2) * ln(2))) / 64) * 64 AS BIGINT)) AS bits FROM c) "
    "SELECT run, n, bits, greatest(1, CAST(round(ln(2) * bits / n) AS BIGINT)) AS hashes FROM b"
)
def bloom_sizing(spark, d):
    c = _runs(spark, d).groupBy("run").agg(F.countDistinct("key").alias("n"))
    bits, hashes = bloom.sizing(F.col("n"), 0.01)
    return c.select("run", "n", bits.alias("bits"), hashes.alias("hashes"))


@query(
    f"WITH {EV}, k AS (SELECT DISTINCT key FROM ev), m AS (SELECT key FROM k WHERE CAST(key AS INTEGER) % 2 = 0) "
    "SELECT (SELECT count(*) FROM m) AS n_members, (SELECT count(*) FROM m) AS n_found, (SELECT count(*) FROM k) - (SELECT count(*) FROM m) AS n_others, TRUE AS rate_kept"
)
def bloom_probe(spark, d):
    """Every second key is a member; the others and 20,000 strangers are found at the stated rate."""
    keys = events_log(spark, d).select("key").distinct().withColumn("member", F.col("key").cast("int") % 2 == 0)
    members = keys.where("member")
    f = bloom.build(members, members.count())
    hit = bloom.probe(keys, f).agg(F.count_if("member").alias("n_members"), F.count_if(F.col("member") & F.col("might_contain")).alias("n_found"), F.count_if(~F.col("member")).alias("n_others"))
    other = bloom.probe(spark.range(20_000).select(F.concat(F.lit("no-"), F.col("id").cast("string")).alias("key")), f)
    return hit.join(F.broadcast(other.agg((F.count_if("might_contain") <= 300 + 300).alias("rate_kept"))), F.lit(True))  # one row


# Accounting


@query(
    f"WITH {_RUNS}, w AS (SELECT run, sum(strlen(key) + CASE WHEN deleted THEN 10 ELSE strlen(value) END) AS written FROM rn GROUP BY run), "
    "l AS (SELECT run, sum(strlen(key) + strlen(value)) AS live FROM (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) AS r FROM rn) WHERE r = 1 AND NOT deleted GROUP BY run) "
    "SELECT w.run, CAST(written AS BIGINT) AS written_bytes, CAST(coalesce(live, 0) AS BIGINT) AS live_bytes, CAST(written * 1000000 // coalesce(live, 1) AS BIGINT) AS write_ppm FROM w LEFT JOIN l USING (run)"
)
def write_amplification(spark, d):
    r = _runs(spark, d)
    written = r.groupBy("run").agg(F.sum(sizes.logical_bytes()).alias("written_bytes"))
    newest = r.groupBy("run", "key").agg(F.max(F.struct("seq", "deleted", "value")).alias("e")).where("NOT e.deleted")
    live = newest.groupBy("run").agg(F.sum(F.octet_length("key") + F.octet_length("e.value")).alias("live"))
    b = F.coalesce("live", F.lit(1)).cast("bigint")
    return written.join(live, "run", "left").select("run", "written_bytes", F.coalesce("live", F.lit(0)).cast("bigint").alias("live_bytes"), F.expr("written_bytes * 1000000 div coalesce(live, 1)").cast("bigint").alias("write_ppm"))


@query(f"WITH {DOCS} SELECT CASE WHEN n > 2048 THEN 'vlog' ELSE 'sst' END AS kind, count(*) AS n_entries, CAST(sum(CASE WHEN n > 2048 THEN 12 + 16 + n ELSE 6 + 16 + n END) AS BIGINT) AS n_bytes FROM dl GROUP BY ALL")
def footprint_by_kind(spark, d):
    placed = values.placement(docs_log(spark, d), 2048)
    size = F.octet_length("key") + F.col("n_bytes") + F.when(F.col("separate"), 12).otherwise(6)
    return placed.groupBy(F.when(F.col("separate"), "vlog").otherwise("sst").alias("kind")).agg(F.count("*").alias("n_entries"), F.sum(size).alias("n_bytes"))


def _profile(spark, deletes: bool) -> DataFrame:
    """The published compaction workloads from generated rows: sizes before and after."""
    ops = spark.range(4).select(F.col("id").alias("r")).select("r", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("i"))
    ops = ops.select((F.col("r") * 256 + F.col("i")).alias("seq"), "i", F.lit(16).alias("k"), ((F.col("r") == 1) & (F.col("i") % 2 == 0)).alias("gone"), "r")
    if deletes:
        ops = ops.where((F.col("r") < 2) | (F.col("i") % 2 == 1))
    ops = ops.withColumn("v", F.when(F.col("gone") & F.lit(deletes), 10).otherwise(512)).withColumn("n", (F.col("k") + F.col("v")).cast("bigint"))
    ops = segment.segments(ops, "n", 32_768, segment.AFTER, ["seq"], out="run")
    newest = ops.groupBy("run", "i").agg(F.max(F.struct("seq", "k", "v")).alias("e")).select("run", "i", "e.k", "e.v")
    before = sizes.run_bytes(newest, "run", "k", "v", ["i"]).agg(F.count("*").alias("n_runs"), F.sum("run_bytes").alias("run_bytes"))
    live = ops.groupBy("i").agg(F.max(F.struct("seq", "k", "v")).alias("e")).select(F.lit(0).alias("run"), "i", "e.k", "e.v").where("v = 512")
    after = sizes.run_bytes(live, "run", "k", "v", ["i"]).select(F.col("n_entries").alias("live_keys"), F.col("run_bytes").alias("compacted_bytes"))
    written = ops.agg(F.count("*").alias("n_ops"), F.sum("n").alias("written_bytes"))
    live_bytes = live.agg(F.sum(F.col("k") + F.col("v")).alias("live_bytes"))
    one = F.lit(True)  # all of one row
    return written.join(F.broadcast(before), one).join(F.broadcast(after), one).join(F.broadcast(live_bytes), one)


def _published(*v: int) -> str:
    names = ("n_ops", "written_bytes", "n_runs", "run_bytes", "live_keys", "compacted_bytes", "live_bytes")
    return "SELECT " + ", ".join(f"CAST({x} AS BIGINT) AS {n}" for n, x in zip(names, v, strict=True))


@query(_published(1024, 540_672, 17, 553_176, 256, 138_164, 135_168))
def overwrite_profile(spark, d):
    return _profile(spark, False)


@query(_published(768, 341_248, 11, 350_032, 128, 69_120, 67_584))
def tombstone_half_profile(spark, d):
    return _profile(spark, True)


# Stored tables


def _new_table(spark, options: Options | None = None) -> KVTable:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strata-kv-")
    return KVTable.open(spark, f"{base}/kv-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}", options)


def _written(spark, ops: DataFrame, options: Options | None = None, cuts: int = 3) -> KVTable:
    """A table with ops (key, seq, deleted, value) committed in as many batches, newest seq range first: order of arrival is not that of seq."""
    t = _new_table(spark, options)
    for i in reversed(range(cuts)):
        t.write(ops.where(F.pmod(F.col("seq"), F.lit(cuts)) == i))
    return t


def _text(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), *more, F.col("value").cast("string").alias("value"))


@query(f"WITH {EV} SELECT key, seq, value FROM live")
def kv_write_compact_scan(spark, d):
    """Three commits, compaction that keeps unsettled tombstones, and a late batch that must not win."""
    ev = events_log(spark, d).drop("shard")
    t = _written(spark, ev.where("seq % 7 <> 3"), Options(value_threshold=40)).compact()
    t.write(ev.where("seq % 7 = 3")).compact()
    return _text(t.scan(), "seq")


@query(f"WITH {EV}, p AS (SELECT lpad(CAST(i AS VARCHAR), 8, '0') AS key FROM range(400) t(i)) SELECT key, value FROM p LEFT JOIN live USING (key)")
def kv_multi_get(spark, d):
    t = _written(spark, events_log(spark, d).drop("shard"), Options(value_threshold=40)).compact()
    return _text(t.get(spark.range(400).select(_padded("id").cast("binary").alias("key"))))


@query(f"WITH {EV}, {_TARGETS} SELECT target, (SELECT max(key) FROM live WHERE key <= target) AS found FROM tg")
def kv_seek_le(spark, d):
    t = _written(spark, events_log(spark, d).drop("shard")).compact()
    found = t.seek(_targets(spark).select(F.col("target").cast("binary").alias("target")), forward=False)
    return found.select(F.col("target").cast("string").alias("target"), F.col("found").cast("string").alias("found"))


@query(f"WITH {EV} SELECT key, seq, value FROM live")
def kv_gc_vacuum_rebuild(spark, d):
    """Values go through garbage collection, old files go, and the manifest is built again from what is left."""
    t = _written(spark, events_log(spark, d).drop("shard"), Options(value_threshold=40)).gc()
    t.vacuum()
    Store(spark, t.path).delete("_manifest")
    return _text(KVTable.open(spark, t.path, t.options).rebuild_manifest().scan(), "seq")


@query(f"WITH {EV} SELECT count(*) AS n_ops, (SELECT count(*) FROM live) AS n_live, (SELECT count(*) FROM live WHERE strlen(value) > 40) AS n_blobs, CAST(0 AS BIGINT) AS n_garbage FROM ev")
def kv_gc_check(spark, d):
    """What is left after garbage collection of a table whose operations are settled."""
    ev = events_log(spark, d).drop("shard")
    t = _written(spark, ev, Options(value_threshold=40)).compact(settled=1 << 40).gc()
    found = t.check()
    sizes = ev.agg(F.count("*").alias("n_ops")).select("n_ops", F.lit(t.entries().count()).cast("bigint").alias("n_live"), F.lit(t.blobs().count()).cast("bigint").alias("n_blobs"))
    return sizes.select("*", F.lit(sum(found.values())).cast("bigint").alias("n_garbage"))


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY shard, seq DESC) AS rn FROM ev) SELECT key, value FROM r WHERE rn = 1 AND NOT deleted")
def kv_log_replay(spark, d):
    """Binary logs, one a shard, with torn tails, are replayed into a table."""
    t = _new_table(spark, Options(value_threshold=40))
    logs = f"{t.path}/logs"
    ev = events_log(spark, d).withColumn("file", F.concat(_padded("shard"), F.lit(".wal")))
    names = formats.write_wal(ev, logs)
    Store(spark, logs).put("99999999.wal", [formats.encode_record(b"never", b"whole")[:-2]])
    assert len(names) <= SHARDS
    return _text(t.replay(logs).replay(logs).scan())


@query(f"WITH {EV} SELECT key, seq, value FROM live")
def kv_stream(spark, d):
    """The log as a stream of files, a commit a micro-batch."""
    t = _new_table(spark)
    events_log(spark, d).drop("shard").select(F.col("key").cast("binary").alias("key"), "seq", "deleted", F.col("value").cast("binary").alias("value")).repartition(4).write.parquet(f"{t.path}/in")
    rows = spark.readStream.schema("key binary, seq bigint, deleted boolean, value binary").option("maxFilesPerTrigger", 2).parquet(f"{t.path}/in")
    q = upsert_stream(rows, t, f"{t.path}/stream")
    if not q.awaitTermination(1800):
        raise RuntimeError("the stream has not ended")
    return _text(t.refresh().scan(), "seq")


@query("SELECT * FROM (VALUES ('L0', CAST(17 AS BIGINT), CAST(1024 AS BIGINT)), ('L1', 1, 256)) t(level, n_runs, n_entries)")
def kv_overwrite_runs(spark, d):
    """The published overwrite workload through a table: runs by rotation, then by compaction."""
    t = _new_table(spark, Options(memtable_max_bytes=32_768))
    ops = spark.range(1024).select(
        F.lpad((F.col("id") % 256).cast("string"), 16, "k").cast("binary").alias("key"), F.col("id").alias("seq"), F.lit(False).alias("deleted"),
        F.rpad((F.col("id") / 256).cast("int").cast("string"), 512, "v").cast("binary").alias("value"),
    )
    rows = [("L0", r["n_entries"]) for r in t.write(ops, rotate=True).manifest.runs] + [("L1", r["n_entries"]) for r in t.compact(settled=1024).manifest.runs]
    return spark.createDataFrame(rows, "level string, n bigint").groupBy("level").agg(F.count("*").alias("n_runs"), F.sum("n").alias("n_entries"))


@query(f"WITH {EV} SELECT CASE WHEN strlen(value) > 40 THEN 'blobs' ELSE 'data' END AS kind, count(*) AS n_rows FROM live GROUP BY ALL")
def kv_footprint(spark, d):
    """Where a settled table's live values are; sizes.footprint finds the manifest's files and no others."""
    t = _written(spark, events_log(spark, d).drop("shard"), Options(value_threshold=40)).compact(settled=1 << 40).gc()
    t.vacuum()
    found = {r["kind"]: (r["n_files"], r["bytes"]) for r in sizes.footprint(spark, t.path).collect()}
    named = [f["size_bytes"] for f in (*t.manifest.runs, *t.manifest.blobs)]
    if found["parquet"] != (len(named), sum(named)):
        raise AssertionError(f"files {found}, named {len(named)} of {sum(named)} bytes")
    place = F.when(F.col("vref").isNull(), "data").otherwise("blobs")
    return t.entries().groupBy(place.alias("kind")).agg(F.count("*").alias("n_rows"))
