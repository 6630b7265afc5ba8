import random
import shutil
import threading

import pytest

from strata.schema import Options
from strata.sources import formats
from strata.table import KVTable, TableClosed, TableLocked

OPS = "key binary, seq bigint, deleted boolean, value binary"


def values(df):
    return {bytes(r.key): None if r.value is None else bytes(r.value) for r in df.collect()}


def test_write_reopen_get_delete_and_shadowing(spark, tmp_path):
    path = str(tmp_path / "t")
    t = KVTable.open(spark, path, Options(value_threshold=32))
    t.put([(b"alpha", b"one"), (b"beta", b"two"), (b"large", b"x" * 128)])
    t.put([(b"alpha", b"o" * 512)])
    t.put([(b"alpha", b"n" * 512)]).delete([b"beta", b"never"])
    again = KVTable.open(spark, path)
    assert len({r["created_at"] for r in again.manifest.runs}) == 4
    assert values(again.get([b"alpha", b"beta", b"large", b"zz"])) == {b"alpha": b"n" * 512, b"beta": None, b"large": b"x" * 128, b"zz": None}
    assert values(again.scan()) == {b"alpha": b"n" * 512, b"large": b"x" * 128}
    assert values(again.scan(b"b", b"m")) == {b"large": b"x" * 128}
    assert values(again.prefix(b"al")) == {b"alpha": b"n" * 512}
    assert values(again.snapshot(1).scan())[b"alpha"] == b"one"
    with pytest.raises(TableLocked):  # another writer, still at an older version
        KVTable.open(spark, path, version=1).put([(b"k", b"v")])
    again.close()
    again.close()
    with pytest.raises(TableClosed):
        again.scan()


def test_thresholds_empty_values_and_sticky_errors(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path / "t"))
    t.put([(b"a", b"x" * 2048), (b"b", b"y" * 2049), (b"e", b"")])
    held = {bytes(r.key): r.vref is not None for r in t.entries().collect()}
    assert held == {b"a": False, b"b": True, b"e": False}
    assert values(t.scan())[b"e"] == b""
    bad = spark.createDataFrame([(b"a", b"1"), (b"a", b"2")], "key binary, value binary")
    with pytest.raises(ValueError, match="unique"):
        t.write(bad)
    with pytest.raises(ValueError, match="unique"):
        t.put([(b"z", b"z")])
    assert KVTable.open(spark, str(tmp_path / "t")).put([(b"z", b"z")]).get([b"z"]).first().value == b"z"


def test_compaction_drops_tombstones_and_gc_keeps_levels(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path / "t"), Options(value_threshold=128))
    for r in range(3):
        t.put([(b"key-%02d" % i, bytes([97 + r]) * 512) for i in range(8)] + [(b"small", b"s")])
    t.delete([b"key-03"])
    want = values(t.scan())
    assert len(want) == 8 and t.check()["garbage"] > 0
    t.compact()
    assert {r["level"] for r in t.manifest.runs} == {1}
    assert {bytes(r.key) for r in t.entries().collect()} == set(want)
    assert values(t.scan()) == want
    before = sum(b["size_bytes"] for b in t.manifest.blobs)
    t.gc()
    assert {r["level"] for r in t.manifest.runs} == {1}
    assert t.check() == {"damaged": 0, "dangling": 0, "garbage": 0}
    assert sum(b["size_bytes"] for b in t.manifest.blobs) < before
    assert {bytes(r.key): r.vref is None for r in t.entries().collect()}[b"small"]
    assert t.vacuum() and values(KVTable.open(spark, t.path).scan()) == want
    assert t.compact() is t
    runs = sorted((r["smallest"], r["largest"]) for r in t.manifest.runs)
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:], strict=False))
    t.rebuild_manifest()
    assert {r["level"] for r in t.manifest.runs} == {0} and values(t.scan()) == want


def test_random_operations_match_a_dict(spark, tmp_path):
    rng, model = random.Random(5), {}
    t = KVTable.open(spark, str(tmp_path / "t"), Options(value_threshold=16))
    for step in range(6):
        keys = [b"k%02d" % rng.randrange(20) for _ in range(12)]
        if step % 3 == 2:
            t.delete(keys[:5])
            for k in keys[:5]:
                model.pop(k, None)
        else:
            pairs = [(k, bytes([rng.randrange(256)]) * rng.randrange(30)) for k in keys]
            t.put(pairs)
            model.update(pairs)
        if step == 3:
            t.compact()
        if step == 4:
            t.gc()
    assert values(t.scan()) == model
    targets = spark.createDataFrame([(b"k05x",), (b"a",), (b"zz",)], "target binary")
    live = sorted(model)
    for forward in (True, False):
        for r in t.seek(targets, forward).collect():
            near = [k for k in live if (k >= r.target if forward else k <= r.target)]
            assert r.found == ((min if forward else max)(near) if near else None)
    assert t.scan(b"k", b"k").count() == 0


def test_streaming_upserts_are_idempotent(spark, tmp_path):
    from strata.streaming import upsert_stream

    src = str(tmp_path / "in")
    schema = "key binary, seq bigint, deleted boolean, value binary"
    for i, rows in enumerate(([(b"a", 5, False, b"new"), (b"b", 6, False, b"x")], [(b"a", 1, False, b"late"), (b"b", 9, True, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{src}/{i}")
    t = KVTable.open(spark, str(tmp_path / "t"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    q = upsert_stream(stream, t, str(tmp_path / "c"))
    q.awaitTermination(120)
    assert q.exception() is None
    t.refresh()
    assert values(t.scan()) == {b"a": b"new"}
    v = t.manifest.version
    t.write(spark.createDataFrame([(b"a", 99, False, b"again")], schema), "upserts", 0)
    assert t.manifest.version == v


def test_late_rows_never_win(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path / "t"))

    def op(key, seq, value=None):
        t.write(spark.createDataFrame([(key, seq, value is None, value)], OPS))

    op(b"k", 10)
    t.compact()
    op(b"k", 5, b"late")
    op(b"new", 4, b"late but alone")
    t.compact().gc()
    assert values(t.scan()) == {b"new": b"late but alone"}
    t.compact(settled=20)  # there is no level-0 run to do it with
    op(b"x", 30, b"x")
    t.compact(settled=20)
    op(b"k", 31, b"again")
    assert values(t.scan()) == {b"new": b"late but alone", b"x": b"x", b"k": b"again"}
    files = set(t._store.walk("data"))
    with pytest.raises(ValueError, match="too late"):
        op(b"k", 20, b"v")
    assert set(t._store.walk("data")) == files  # a refused batch leaves nothing


def test_rebuild_after_a_lost_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    t = KVTable.open(spark, path, Options(value_threshold=32))
    t.write(spark.createDataFrame([(b"a", 1, False, b"x" * 100), (b"b", 2, False, b"small")], OPS), "stream", 3)
    t.write(spark.createDataFrame([(b"b", 3, True, None)], OPS))
    other = KVTable.open(spark, path, Options(value_threshold=32), version=1)
    with pytest.raises(TableLocked):
        other.write(spark.createDataFrame([(b"a", 99, False, b"lost")], OPS))
    t.compact()
    want = values(t.scan())
    shutil.rmtree(tmp_path / "t" / "_manifest")
    again = KVTable.open(spark, path, Options(value_threshold=32)).rebuild_manifest()
    assert values(again.scan()) == want == {b"a": b"x" * 100} and {r["level"] for r in again.manifest.runs} == {0}
    again.put([(b"c", b"y" * 100)])
    assert values(again.scan()) == {**want, b"c": b"y" * 100} and again.manifest.next_seq > 3
    v = again.manifest.version
    again.write(spark.createDataFrame([(b"a", 100, False, b"twice")], OPS), "stream", 3)
    assert again.manifest.version == v and again.check() == {"damaged": 0, "dangling": 0, "garbage": 0}


def test_rotation_gives_a_run_a_memtable(spark, tmp_path):
    """The published overwrite workload: 1,024 operations fill 17 memtables, and compact to one run."""
    t = KVTable.open(spark, str(tmp_path / "t"), Options(memtable_max_bytes=32_768))
    ops = [(b"k%015d" % i, r * 256 + i, False, bytes([97 + r]) * 512) for r in range(4) for i in range(256)]
    t.write(spark.createDataFrame(ops, OPS), rotate=True)
    assert len(t.manifest.runs) == 17
    t.compact(settled=2000)
    assert len(t.manifest.runs) == 1 and sum(len(k) + len(v) for k, v in values(t.scan()).items()) == 135_168


def test_outputs_are_split_by_size(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path / "t"), Options(memtable_max_bytes=4 << 20, value_threshold=4 << 20))
    t.put([(b"k%02d" % i, bytes([i]) * (1 << 20)) for i in range(10)])
    t.compact()
    sizes = sorted(r["n_entries"] for r in t.manifest.runs)
    assert sum(sizes) == 10 and max(sizes) <= 4 and len(sizes) >= 3  # four entries fill a file
    runs = sorted((r["smallest"], r["largest"]) for r in t.manifest.runs)
    assert all(a[1] < b[0] for a, b in zip(runs, runs[1:], strict=False))
    t.gc()
    assert max(r["n_entries"] for r in t.manifest.runs) <= 4 and {r["level"] for r in t.manifest.runs} == {1} and t.scan().count() == 10


def test_replay_of_leftover_logs(spark, tmp_path):
    logs = str(tmp_path / "logs")
    ops = spark.createDataFrame(
        [("1.wal", 1, b"a", False, b"one"), ("1.wal", 2, b"b", False, b"x" * 200), ("2.wal", 1, b"a", True, None), ("2.wal", 2, b"c", False, b"two")],
        "file string, seq bigint, key binary, deleted boolean, value binary",
    )
    assert sorted(formats.write_wal(ops, logs)) == ["1.wal", "2.wal"]
    with open(f"{logs}/2.wal", "ab") as f:
        f.write(b"torn")
    (tmp_path / "logs" / ".2.wal.crc").unlink()  # the local file system's own checksum
    t = KVTable.open(spark, str(tmp_path / "t"), Options(value_threshold=64)).put([(b"b", b"old"), (b"d", b"kept")])
    t.replay(logs)
    want = {b"b": b"x" * 200, b"c": b"two", b"d": b"kept"}
    assert values(t.scan()) == want and {bytes(r.key) for r in t.entries().where("vref IS NOT NULL").collect()} == {b"b"}
    v = t.manifest.version
    assert t.replay(logs).manifest.version == v and values(KVTable.open(spark, t.path).scan()) == want


def test_acks_and_group_commits(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path / "a"), Options(ack="async", batch_rows=3))
    t.put([(b"a", b"1")]).delete([b"b"])
    assert t.syncs == 0 and values(t.scan()) == {b"a": b"1"} and KVTable.open(spark, t.path).scan().count() == 0
    t.put([(b"a", b"2")])
    assert t.syncs == 1 and values(KVTable.open(spark, t.path).scan()) == {b"a": b"2"}
    t.put([(b"c", b"3")]).close()
    assert t.syncs == 2 and values(KVTable.open(spark, t.path).scan()) == {b"a": b"2", b"c": b"3"}
    g = KVTable.open(spark, str(tmp_path / "g"), Options(write_batch_window_s=0.05))
    threads = [threading.Thread(target=g.put, args=([(b"k%d" % i, b"v")],)) for i in range(8)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert 1 <= g.syncs <= 7 and g.scan().count() == 8 and KVTable.open(spark, g.path).scan().count() == 8


def test_ordered_iteration_and_pruned_lookups(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path / "t"), Options(value_threshold=16, segment_max_bytes=256))
    for r in range(3):
        t.put([(b"k%d%02d" % (r, i), bytes([97 + r]) * 64) for i in range(20)])
    assert [bytes(r.key) for r in t.iterate(b"k0", b"k1")] == [b"k0%02d" % i for i in range(20)]
    assert bytes(next(t.iterate(reverse=True)).key) == b"k219"
    got = t.get([b"k105", b"nope"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert values(got) == {b"k105": b"b" * 64, b"nope": None} and "segment_id" in plan
    read = {f for f in got.inputFiles() if "/blobs/" in f}
    assert len(read) < len(t.manifest.blobs)


def test_keyed_state_follows_the_newest_entry(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    from strata.streaming import latest_changes

    src = str(tmp_path / "in")
    for i, rows in enumerate(([(b"a", 5, False, b"new"), (b"b", 6, False, b"x"), (b"a", 3, False, b"old")], [(b"a", 1, False, b"late"), (b"b", 9, True, None)])):
        spark.createDataFrame(rows, OPS).coalesce(1).write.parquet(f"{src}/{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
        q = latest_changes(stream).writeStream.format("memory").queryName("newest_entries").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination(120)
        assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    seen = sorted((bytes(r.key), r.seq, r.deleted) for r in spark.table("newest_entries").collect())
    assert seen == [(b"a", 5, False), (b"b", 6, False), (b"b", 9, True)]
