"""A keyed table: writes, lookups, scans, snapshots, replay, compaction, garbage collection."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.functions.sizes import logical_bytes
from strata.operators import merge, metadata, seek, values
from strata.operators.segment import AFTER, numbered, segments
from strata.schema import BLOB, ENTRY, META, STORED_BLOB, TOMBSTONE, Options
from strata.sources.formats import read_wal
from strata.sources.manifest import STATE, Manifest, Store, TableLocked, blob_metadata, commit, load, run_metadata, versions

__all__ = ["KVTable", "TableClosed", "TableLocked"]

#: References of one lookup up to which its blobs are found by a pushed-down filter.
FEW = 1000


class TableClosed(RuntimeError):
    """The table has been closed."""


class KVTable:
    """Upserts and deletes merged newest-wins, over layered sorted Parquet runs.

    Every call plans DataFrames over the manifest version that the table holds; ``refresh`` moves it to
    the newest.  A commit fails with TableLocked, and leaves no file, if another writer got there first.
    The first failed write is kept and raised by every later one until the table is opened again.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options, manifest: Manifest):
        self.spark, self.path, self.options, self.manifest = spark, path.rstrip("/"), options, manifest
        self._store, self._closed, self._failed = Store(spark, path), False, None
        self._requests: list[tuple[int, list]] = []  # (ticket, rows) not committed yet
        self._queue, self._commits = threading.Lock(), threading.RLock()
        self._ticket, self._done, self._next = 0, 0, manifest.next_seq
        self._lost: dict[int, Exception] = {}  # by ticket, for the callers whose group failed
        self._since = self._last = 0.0
        #: Commits made for put and delete calls.
        self.syncs = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None, version: int | None = None) -> KVTable:
        return cls(spark, path, options or Options(), load(Store(spark, path), version))

    def close(self) -> None:
        """Commits what waits; further calls fail; closing again does nothing."""
        if not self._closed and not self._failed:
            self.flush()
        self._closed = True

    def _ready(self, writing: bool = False) -> None:
        if self._closed:
            raise TableClosed(self.path)
        if writing and self._failed:
            raise self._failed

    def refresh(self) -> KVTable:
        self._ready()
        self.manifest = load(self._store)
        self._next = max(self._next, self.manifest.next_seq)
        return self

    def snapshot(self, version: int) -> KVTable:
        """A reader of an earlier version, until vacuum removes its files."""
        self._ready()
        return KVTable(self.spark, self.path, self.options, load(self._store, version))

    # Writing

    def put(self, pairs) -> KVTable:
        """Upserts (key, value) pairs, later ones newer."""
        return self._submit([(bytes(k), False, None if v is None else bytes(v)) for k, v in pairs])

    def delete(self, keys) -> KVTable:
        """Deletes keys, whether or not they exist."""
        return self._submit([(bytes(k), True, None) for k in keys])

    def _submit(self, rows) -> KVTable:
        self._ready(writing=True)
        o = self.options
        with self._queue:
            if not self._requests:
                self._since = time.monotonic()
            self._next = max(self._next, self.manifest.next_seq)
            self._requests.append((self._ticket, [(k, self._next + i, d, v) for i, (k, d, v) in enumerate(rows)]))
            mine, self._ticket, self._next = self._ticket, self._ticket + 1, self._next + len(rows)
            due = len(self._requests) >= o.batch_rows or time.monotonic() - self._since >= o.sync_interval_s > 0
        if o.ack == "async":
            return self.flush() if due else self
        with self._commits:  # whoever comes first commits for all that wait
            if mine >= self._done:
                if o.sync_interval_s > 0:
                    time.sleep(max(0.0, self._last + o.sync_interval_s - time.monotonic()))
                elif o.write_batch_window_s > 0 and self._ticket - self._done > 1:
                    time.sleep(o.write_batch_window_s)
                try:
                    self.flush()
                except Exception:
                    if mine not in self._lost:
                        raise
            if mine in self._lost:
                raise self._lost.pop(mine)
        return self

    def flush(self) -> KVTable:
        """Commits the put and delete calls that wait, in groups of up to ``batch_rows`` calls."""
        self._ready(writing=True)
        with self._commits:
            while self._requests:
                group = self._requests[: self.options.batch_rows]
                rows = [r for _, own in group for r in own]
                try:
                    if rows:
                        self._write(self.spark.createDataFrame(rows, "key binary, seq bigint, deleted boolean, value binary"), own=True)
                except Exception as e:
                    if self.options.ack == "sync":
                        self._lost |= {t: e for t, _ in group}
                    raise
                finally:
                    with self._queue:
                        self._requests = self._requests[len(group) :]
                        self._done = group[-1][0] + 1
                self.syncs, self._last = self.syncs + 1, time.monotonic()
        return self

    def write(self, ops: DataFrame, query: str | None = None, batch_id: int | None = None, rotate: bool = False) -> KVTable:
        """Commits a batch of operations (key, value, deleted, seq) as level-0 runs.

        Without ``deleted`` all are upserts; without ``seq`` all are newer than anything in the table, and
        keys must be unique.  A batch of a (query, batch_id) that has been committed is skipped.  With
        ``rotate`` the operations fill memtables of ``memtable_max_bytes`` one after the other, in seq order,
        and each becomes a run; otherwise the batch is merged as a whole into runs that do not overlap.
        """
        self._ready(writing=True)
        self.flush()
        if query is not None and self.manifest.batches.get(query, -1) >= batch_id:
            return self
        return self._write(ops, {query: batch_id} if query is not None else {}, rotate)

    def _write(self, ops: DataFrame, batches: dict | None = None, rotate: bool = False, own: bool = False) -> KVTable:
        try:
            self.manifest = self._written(ops, batches or {}, rotate, own or "seq" not in ops.columns)
        except TableLocked:
            raise
        except Exception as e:
            self._failed = e
            raise
        return self

    def _written(self, ops: DataFrame, batches: dict, rotate: bool, own: bool) -> Manifest:
        m = self.manifest
        if "deleted" not in ops.columns:
            ops = ops.withColumn("deleted", F.lit(False))
        if "seq" not in ops.columns:
            if not ops.groupBy("key").count().where("count > 1").isEmpty():
                raise ValueError("keys of a batch without seq must be unique")
            ops = ops.withColumn("seq", F.lit(m.next_seq).cast("bigint"))
        value = F.when(~F.col("deleted"), F.col("value").cast("binary"))
        log = ops.select(F.col("key").cast("binary").alias("key"), F.col("seq").cast("bigint").alias("seq"), "deleted", value.alias("value"))
        log = log.withColumn("vref", F.lit(None).cast(ENTRY["vref"].dataType))
        if rotate:
            filled = segments(log.withColumn("n", logical_bytes()), "n", self.options.memtable_max_bytes, AFTER, ["seq", "key"], out="part").drop("n")
            newest = filled.groupBy("key", "part").agg(F.max(F.struct("seq", "deleted", "value", "vref")).alias("e")).select("key", "e.*", "part")
        else:
            newest = merge.latest(log)
        runs, blobs, segment, places = self._store_entries(newest, 0, m.version + 1, m.next_segment)
        low = min((r["min_seq"] for r in runs), default=None)
        if low is not None and low <= m.settled:
            self._discard(places)
            raise ValueError(f"seq {low} comes too late: the table is settled up to {m.settled}")
        top = max([r["max_seq"] for r in runs], default=0)
        return self._commit(
            places, runs=runs + m.runs, blobs=m.blobs + blobs, next_seq=max(m.next_seq, top + 1), next_segment=segment, batches={**m.batches, **batches}, own_seq=m.own_seq and own
        )

    def replay(self, path: str, tombstone: bytes = TOMBSTONE, on_damage: str = "fail") -> KVTable:
        """Commits the operations of leftover binary logs below path, in the order of their names; each log once.

        Torn tails are dropped, and values of more than the threshold are separated again.  Logs are
        read and placed in parallel; only their record counts come to the driver.
        """
        self._ready(writing=True)
        self.flush()
        records = read_wal(self.spark, path, on_damage).withColumn("log", F.concat(F.lit("log:"), F.substring_index("path", "/", -1)))
        sizes = {r["log"]: r["n"] for r in records.groupBy("log").agg(F.count("*").alias("n")).collect()}
        new, at, starts = sorted(x for x in sizes if x not in self.manifest.batches), max(self._next, self.manifest.next_seq), []
        for name in new:
            starts.append((name, at))
            at += sizes[name]
        if not new:
            return self
        first = F.broadcast(self.spark.createDataFrame(starts, "log string, start bigint"))  # a row per log file
        place = F.row_number().over(W.partitionBy("log").orderBy("pos")) - 1
        ops = records.join(first, "log").select("key", (F.col("start") + place).alias("seq"), (F.col("value") == F.lit(tombstone)).alias("deleted"), "value")
        return self._write(ops, dict.fromkeys(new, 0), own=True)

    def _store_entries(self, entries: DataFrame, level: int, created_at: int, segment: int, target: int | None = None):
        """Writes entries as sorted runs, their large values as blobs; (runs, blob files, next segment, new folders).

        entries are evaluated once, into a staging folder; references are read back from the blobs as
        written.  A column ``part`` names the file of an entry; else, with a target, a file is closed
        by the entry that fills it with so many logical bytes.
        """
        tag, o = f"L{level}-{created_at:010d}-{uuid.uuid4().hex[:8]}", self.options
        staging, place, blob_place = f"staging/{tag}", f"data/{tag}", f"blobs/{tag}"
        more = [c for c in ("part",) if c in entries.columns]
        far = F.col("vref").isNull() & F.coalesce(F.octet_length("value") > o.value_threshold, F.lit(False))
        try:
            staged = entries.select(*ENTRY.names, *more, far.cast("int").alias("far"))
            staged.write.partitionBy("far").parquet(f"{self.path}/{staging}")
            held = self.spark.read.schema(staged.schema).parquet(f"{self.path}/{staging}")
            stored, blobs = held.where("far = 0").drop("far"), []
            if any("/far=1/" in n for n, _ in self._store.walk(staging)):
                shards = self.spark.sparkContext.defaultParallelism
                large = held.where("far = 1").withColumn("shard", F.pmod(F.hash("key"), F.lit(shards)))
                put = values.placed(large, o.segment_max_bytes, segment, "shard").select(*STORED_BLOB.names, *more)
                put.repartition("segment_id").sortWithinPartitions("segment_id", "offset").write.parquet(f"{self.path}/{blob_place}")
                blobs = blob_metadata(self.spark, [(n, s) for n, s in self._store.walk(blob_place) if n.endswith(".parquet")], self.path, blob_place)
                vref = F.struct("segment_id", "offset", "value_len", "checksum")
                refs = self.spark.read.parquet(f"{self.path}/{blob_place}").select(
                    "key", "seq", F.lit(False).alias("deleted"), F.lit(None).cast("binary").alias("value"), vref.alias("vref"), *more
                )
                stored = stored.unionByName(refs)
            self._write_runs(stored, place, target)
        finally:
            self._store.delete(staging)
        files = [f"{self.path}/{n}" for n, _ in self._store.walk(place) if n.endswith(".parquet")]
        runs = run_metadata(self.spark, files, level, created_at, place)
        if not runs:
            self._store.delete(place)
        # Segment numbers of a batch start at ``segment``; shards lie 2**32 apart, so one batch takes as many as its largest shard.
        return runs, blobs, self._next_segment(segment, blob_place, blobs), [place, blob_place]

    def _next_segment(self, least: int, place: str, blobs: list[dict]) -> int:
        if not blobs:
            return least
        held = self.spark.read.schema("segment_id bigint").parquet(*[f"{self.path}/{b['filename']}" for b in blobs])
        return max(least, held.agg(F.max(F.col("segment_id").bitwiseAND(F.lit(0xFFFFFFFF)))).first()[0] + 1)

    def _write_runs(self, stored: DataFrame, place: str, target: int | None) -> None:
        if "part" in stored.columns:
            out = stored.repartition("part").sortWithinPartitions("part", "key")
        else:
            out = stored.repartitionByRange("key").sortWithinPartitions("key")
            if target is not None:
                value = F.coalesce(F.col("vref.value_len"), logical_bytes() - F.octet_length("key"))
                out = numbered(out.withColumn("n", (F.octet_length("key") + value).cast("bigint")), "n", target, AFTER, "part")
                out = out.drop("n").sortWithinPartitions("part", "key")
        write = out.write.partitionBy("part") if "part" in out.columns else out.write
        write = write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.options.bloom_fpp))
        write.parquet(f"{self.path}/{place}")

    # Commits

    def _discard(self, places: list[str]) -> None:
        for p in places:
            self._store.delete(p)

    def _commit(self, places: list[str], gone=(), **changes) -> Manifest:
        """Commits; new folders are deleted if that fails, and marked as committed else, with what they replace."""
        m = self.manifest
        self._mark(m, {"/".join(r["filename"].split("/")[:2]) for r in m.runs if r["created_at"] == m.version}, ())  # the last writer may have died
        try:
            new = commit(self._store, m, **changes)
        except TableLocked:
            self._discard(places)
            raise
        self._mark(new, places, gone)
        return new

    def _mark(self, m: Manifest, places, gone) -> None:
        state = json.dumps({"version": m.version, "gone": sorted(gone), **{k: getattr(m, k) for k in STATE[2:]}})
        for p in places:
            if self._store.exists(p) and not self._store.exists(f"{p}/_committed"):
                self._store.put(f"{p}/_committed", [state.encode()])

    # Reading

    def metadata(self) -> DataFrame:
        """META rows of the runs."""
        rows = [tuple(r[c] for c in META.names) for r in self.manifest.runs]
        return self.spark.createDataFrame(rows, META)

    def entries(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All versions with low <= key < high, tombstones included; runs outside the bounds are not opened."""
        self._ready()
        files = [r["filename"] for r in self.manifest.runs if (low is None or r["largest"] >= low) and (high is None or r["smallest"] < high)]
        held = self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/{f}" for f in files]) if files else self.spark.createDataFrame([], ENTRY)
        with self._queue:
            waiting = [(*r, None) for _, rows in self._requests for r in rows]  # batch_rows calls at most
        if waiting:
            held = held.unionByName(self.spark.createDataFrame(waiting, ENTRY))
        return seek.key_range(held, low, high)

    def blobs(self) -> DataFrame:
        return self._blobs(self.manifest.blobs)

    def _blobs(self, files: list[dict]) -> DataFrame:
        return self.spark.read.schema(BLOB).parquet(*[f"{self.path}/{b['filename']}" for b in files]) if files else self.spark.createDataFrame([], BLOB)

    def scan(self, low: bytes | None = None, high: bytes | None = None, keys_only: bool = False) -> DataFrame:
        """Live (key, value, seq) with low <= key < high; keys_only leaves values unread."""
        found = self.entries(low, high)
        if keys_only:
            return merge.live(found.select("key", "seq", "deleted")).select("key", "seq")
        live = merge.live(found)
        return (values.resolve(live, self.blobs()) if self.manifest.blobs else live).select("key", "value", "seq")

    def ordered(self, low: bytes | None = None, high: bytes | None = None, reverse: bool = False) -> DataFrame:
        """As scan, in key order or against it."""
        return self.scan(low, high).orderBy(F.desc("key") if reverse else F.asc("key"))

    def iterate(self, low: bytes | None = None, high: bytes | None = None, reverse: bool = False) -> Iterator[Row]:
        """The rows of ``ordered`` one after the other; the driver holds a partition at a time."""
        return self.ordered(low, high, reverse).toLocalIterator()

    def prefix(self, prefix: bytes) -> DataFrame:
        end = prefix.rstrip(b"\xff")
        return self.scan(prefix, end[:-1] + bytes([end[-1] + 1]) if end else None)

    def get(self, keys) -> DataFrame:
        """(key, value) for every key of a DataFrame (column ``key``) or list; null values where absent.

        Runs outside the probes' bounds are skipped, and a semi-join keeps other keys out of the merge.
        Blob files are pruned by the segments that the found references name; of a FEW references,
        segments and offsets reach the scan as a filter.
        """
        self._ready()
        probes = keys if isinstance(keys, DataFrame) else self.spark.createDataFrame([(bytes(k),) for k in keys], "key binary")
        lo, hi = probes.agg(F.min("key"), F.max("key")).first()
        found = self.entries(None if lo is None else bytes(lo), None if hi is None else bytes(hi) + b"\x00")
        live = merge.live(found.join(probes.select("key").distinct(), "key", "left_semi"))
        if self.manifest.blobs:
            refs = live.where("vref IS NOT NULL").select("vref.segment_id", "vref.offset").limit(FEW + 1).collect()
            files = self.manifest.blobs
            if len(refs) <= FEW:
                files = [b for b in files if any(b["lo"] <= r.segment_id <= b["hi"] for r in refs)]
            blobs = self._blobs(files)
            if len(refs) <= FEW:
                blobs = blobs.where(F.col("segment_id").isin({r.segment_id for r in refs}) & F.col("offset").isin({r.offset for r in refs}))
            live = values.resolve(live, blobs)
        return merge.multi_get(probes, live.select("key", "value"))

    def seek(self, targets: DataFrame, forward: bool = True) -> DataFrame:
        """Targets (column ``target``) with the nearest live key at or after them (forward) or at or before."""
        edges = sorted({r["smallest"] for r in self.manifest.runs if r["level"] > 0}) or None
        return seek.seek(targets, self.scan(keys_only=True), forward, edges=edges)

    # Maintenance

    def compact(self, settled: int | None = None) -> KVTable:
        """Merges the level-0 runs chained to the oldest one with the level-1 runs they overlap; without level-0 runs, nothing.

        A tombstone goes only if no operation that it hides can still come: if its seq is at most
        ``settled``, a promise that later writes are held to.  Where the table has given every seq
        itself, all so far is settled.
        """
        self._ready(writing=True)
        self.flush()
        m = self.manifest
        settled = max(m.settled, m.next_seq - 1 if m.own_seq else 0, settled or 0)
        plan = metadata.plan_compaction(self.metadata()).select("filename", "drop_tombstones").collect()  # file names: manifest-sized
        if not plan:
            return self
        gone = {r.filename for r in plan}
        held = self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/{f}" for f in gone])
        # Later level-0 runs outside the plan do not overlap it, so the merge sees every version of its keys.
        merged = merge.latest(held)
        if plan[0].drop_tombstones:
            merged = merged.where(~F.col("deleted") | (F.col("seq") > settled))
        runs, _, _, places = self._store_entries(merged, 1, m.version + 1, m.next_segment, self.options.target_file_bytes)
        self.manifest = self._commit(places, gone, runs=[r for r in m.runs if r["filename"] not in gone] + runs, settled=settled)
        return self

    def gc(self) -> KVTable:
        """Rewrites live entries at their levels and their large values into new blobs; all else is dropped.

        A file is closed by the entry that fills it with ``memtable_max_bytes`` of keys and values.
        Tombstones that may still hide a late operation stay.
        """
        self._ready(writing=True)
        self.flush()
        m = self.manifest
        if not m.runs:
            return self
        runs, blobs, places, segment = [], [], [], m.next_segment
        settled = max(m.settled, m.next_seq - 1 if m.own_seq else 0)
        levels = sorted({r["level"] for r in m.runs})
        tagged = None
        for level in levels:
            files = [f"{self.path}/{r['filename']}" for r in m.runs if r["level"] == level]
            own = self.spark.read.schema(ENTRY).parquet(*files).withColumn("level", F.lit(level))
            tagged = own if tagged is None else tagged.unionByName(own)
        live = merge.latest(tagged).where(~F.col("deleted") | (F.col("seq") > settled))
        live = values.resolve(live, self.blobs()).withColumn("vref", F.lit(None).cast(ENTRY["vref"].dataType))
        for level in levels:
            made = self._store_entries(live.where(F.col("level") == level).drop("level"), level, m.version + 1, segment, self.options.memtable_max_bytes)
            runs, blobs, segment, places = runs + made[0], blobs + made[1], made[2], places + made[3]
        gone = [f["filename"] for f in (*m.runs, *m.blobs)]
        self.manifest = self._commit(places, gone, runs=runs, blobs=blobs, next_segment=segment, settled=settled)
        return self

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Deletes manifests before the last keep_versions and files that no kept one names; returns the files."""
        self._ready(writing=True)
        held = versions(self._store)
        kept = [load(self._store, v) for v in held[-keep_versions:]]
        named = {f["filename"] for m in kept for f in (*m.runs, *m.blobs)}
        gone = [n for sub in ("data", "blobs") for n, _ in self._store.walk(sub) if n.endswith(".parquet") and n not in named]
        for n in gone:
            self._store.delete(n)
        for v in held[:-keep_versions]:
            self._store.delete(f"_manifest/v{v:010d}.json")
        return gone

    def rebuild_manifest(self) -> KVTable:
        """A manifest from the run files alone, all at level 0.

        Folders carry a mark of their commit: files without one, of writers that failed, and files that
        a later commit has replaced are left out, and counters go on where the last commit left them.
        """
        self._ready(writing=True)
        found = {sub: [(n, s) for n, s in self._store.walk(sub) if n.endswith((".parquet", "/_committed"))] for sub in ("data", "blobs")}
        marks = {n.rsplit("/", 1)[0]: json.loads(self._store.read(n)) for held in found.values() for n, _ in held if n.endswith("/_committed")}
        gone = {f for x in marks.values() for f in x["gone"]}
        last = max(marks.values(), key=lambda x: x["version"], default={"version": 0})
        base = Manifest(max(self.manifest.version, last["version"]), **{k: last[k] for k in STATE[2:] if k in last})
        runs, blobs = [], []
        for place in sorted(marks):
            files = [(n, s) for n, s in found[place.split("/")[0]] if n.startswith(place + "/") and n.endswith(".parquet") and n not in gone]
            if place.startswith("data/"):
                runs += run_metadata(self.spark, [f"{self.path}/{n}" for n, _ in files], 0, base.version + 1, place)
            else:
                blobs += blob_metadata(self.spark, files, self.path, place)
        top = max([r["max_seq"] for r in runs], default=0)
        segment = self._next_segment(base.next_segment, "blobs", blobs)
        self.manifest = commit(self._store, base, runs=runs, blobs=blobs, next_seq=max(base.next_seq, top + 1), next_segment=segment)
        return self

    def check(self) -> dict[str, int]:
        """Counts of damaged blobs, dangling references and garbage blobs."""
        live, blobs = merge.live(self.entries()), self.blobs()
        refs = live.where("vref IS NOT NULL").select("vref.segment_id", "vref.offset")
        return {
            "damaged": values.damaged(blobs).count(),
            "dangling": refs.join(blobs, ["segment_id", "offset"], "left_anti").count(),
            "garbage": values.garbage(blobs, live).count(),
        }
