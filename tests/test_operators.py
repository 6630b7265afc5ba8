import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions import bloom, encoding
from strata.operators import metadata, seek, segment, values
from strata.sources import formats


def test_planner_picks_the_oldest_island_and_its_targets(spark):
    rows = [("400", 0, b"a", b"c", 1, 400), ("300", 0, b"m", b"p", 1, 300), ("200", 0, b"x", b"z", 1, 200),
            ("100", 1, b"a", b"f", 1, 100), ("101", 1, b"m", b"s", 1, 101), ("102", 1, b"x", b"zz", 1, 102)]
    meta = spark.createDataFrame(rows, "filename string, level int, smallest binary, largest binary, size_bytes bigint, created_at bigint")
    plan = {(r.filename, r.role, r.target_level, r.drop_tombstones) for r in metadata.plan_compaction(meta).collect()}
    assert plan == {("200", "source", 1, True), ("102", "target", 1, True)}
    assert metadata.plan_compaction(meta.where("level > 0")).count() == 0


def test_segments(spark):
    blocks = spark.createDataFrame([(k, 1400 + 7) for k in "abcde"], "k string, n bigint")
    got = segment.segments(blocks, "n", 4096, segment.BEFORE, ["k"]).collect()
    assert [r.segment for r in got] == [0, 0, 1, 1, 2]
    logs = spark.createDataFrame([(s, i, n) for s in (1, 2) for i, n in enumerate((49, 56, 10))], "s int, i int, n bigint")
    out = segment.offsets(segment.segments(logs, "n", 96, segment.BEFORE, ["i"], by="s").selectExpr("*", "s * 10 + segment AS g"), "n", "g", ["i"])
    assert sorted((r.s, r.i, r.segment, r.offset) for r in out.collect()) == [(s, i, g, o) for s in (1, 2) for i, g, o in ((0, 0, 0), (1, 1, 0), (2, 1, 56))]
    after = segment.segments(logs.where("s = 1"), "n", 100, segment.AFTER, ["i"]).collect()
    assert [r.segment for r in after] == [0, 0, 1]
    assert segment.segments(logs.limit(0), "n", 96, segment.AFTER, ["i"]).count() == 0


def test_cuts_against_a_running_size():
    rng = random.Random(8)
    for trial in range(400):
        rule, limit = (segment.AFTER, segment.BEFORE)[trial % 2], rng.randint(1, 30)
        sizes = [rng.choice((0, 0, 1, 3, 7, 12, 40)) for _ in range(rng.randint(1, 40))]
        want, number, held = [], 0, 0
        for n in sizes:
            if rule == segment.BEFORE and held > 0 and held + n > limit:
                number, held = number + 1, 0
            want.append(number)
            held += n
            if rule == segment.AFTER and held >= limit:
                number, held = number + 1, 0
        at = rng.randint(0, len(sizes))  # in two batches
        first, more, left = segment.cut_sizes(np.array(sizes[:at], np.int64), 0, limit, rule)
        second, more2, left = segment.cut_sizes(np.array(sizes[at:], np.int64), left, limit, rule)
        assert [*first.tolist(), *(second + more).tolist()] == want and (more + more2, left) == (number, held)


def test_cursor_cases(spark):
    keys = spark.createDataFrame([(k,) for k in "badc"], "key string")
    t = spark.createDataFrame([("bb",), ("z",), ("A",)], "target string")
    for edges in ([], ["b", "c"]):
        assert {r.target: r.found for r in seek.seek(t, keys, edges=edges).collect()} == {"bb": "c", "z": None, "A": "a"}
        assert {r.target: r.found for r in seek.seek(t, keys, False, edges=edges).collect()} == {"bb": "b", "z": "d", "A": None}
        near = sorted((r.key, r.prev_key, r.next_key) for r in seek.neighbours(keys, edges=edges).collect())
        assert near == [("a", None, "b"), ("b", "a", "c"), ("c", "b", "d"), ("d", "c", None)]


def test_bloom_round_trip_rates_and_errors(spark):
    members, probes = [b"key-%d" % i for i in range(5000)], [b"no-%d" % i for i in range(50_000)]
    f = bloom.Bloom.sized(5000, 0.01)
    f.add(members)
    assert f.contains(members).all() and f.contains(probes).mean() <= 0.015
    g = bloom.Bloom.from_bytes(f.to_bytes())
    assert g.to_bytes() == f.to_bytes()
    for bad in (b"", b"x" * 30, f.to_bytes()[:-1]):
        with pytest.raises(ValueError):
            bloom.Bloom.from_bytes(bad)
    df = spark.createDataFrame([(m,) for m in members], "key binary").repartition(40)
    assert bloom.build(df, 5000).to_bytes() == f.to_bytes()
    assert bloom.probe(df, f).where("might_contain").count() == 5000


def test_sharded_filters(spark, monkeypatch):
    members = spark.range(3000).selectExpr("concat('m', id) AS key")
    others = spark.range(20_000).selectExpr("concat('o', id) AS key")
    monkeypatch.setattr(bloom, "BROADCAST_BITS", 4096)
    filters = bloom.build_shards(members.union(members), 3000)
    assert filters.count() == filters.first().shards == 8
    got = bloom.probe_shards(members.union(others).union(spark.sql("SELECT CAST(NULL AS STRING)")), filters).collect()
    assert len(got) == 23_000 and all(r.might_contain for r in got if r.key[0] == "m") and sum(r.might_contain for r in got if r.key[0] == "o") < 300
    assert bloom.probe_shards(members, bloom.build_shards(members.limit(0), 0)).where("might_contain").count() == 0
    with pytest.raises(ValueError, match="broadcast"):
        bloom.probe(members, bloom.Bloom.sized(3000))


def test_binary_formats(spark, tmp_path):
    recs = [(b"a", b"1" * 30), (b"b", b"")]
    log = b"".join(formats.encode_record(k, v) for k, v in recs)
    (tmp_path / "1.wal").write_bytes(log)
    (tmp_path / "2.wal").write_bytes(log[:-2])
    assert sorted((r.path[-5:], bytes(r.key)) for r in formats.read_wal(spark, str(tmp_path)).collect()) == [("1.wal", b"a"), ("1.wal", b"b"), ("2.wal", b"a")]
    broken = bytearray(log)
    broken[14] ^= 1
    with pytest.raises(formats.Damaged):
        list(formats.records(bytes(broken)))
    assert not list(formats.records(bytes(broken), "truncate"))
    (tmp_path / f"{7:020d}.vlog").write_bytes(log)
    assert [(r.segment_id, r.offset) for r in formats.read_value_log(spark, str(tmp_path)).orderBy("offset").collect()] == [(7, 0), (7, len(formats.encode_record(*recs[0])))]
    run = [(k.encode(), b"v" * 1400) for k in "abcde"]
    (tmp_path / "9.sst").write_bytes(formats.encode_run(run))
    assert sorted((bytes(r.key), bytes(r.value)) for r in formats.read_runs(spark, str(tmp_path)).collect()) == run
    assert sorted(bytes(r.first_key) for r in formats.read_run_index(spark, str(tmp_path)).collect()) == [b"a", b"c", b"e"]
    with pytest.raises(ValueError, match="block"):
        formats.encode_run([(b"a", b"x" * 4096)])
    made = formats.encode_run(run)
    for bad in (b"x" * 20, b"\0" * 4 + made[4:], made[:5] + (1 << 40).to_bytes(8, "little") + made[13:], made[:-13] + (10).to_bytes(8, "little") + made[-5:], made[:-1] + b"\x07"):
        with pytest.raises(formats.Damaged):
            formats.run_index(bad)
    m = [{"filename": "9.sst", "level": 0, "smallest": b"a", "largest": b"e", "size_bytes": 1, "created_at": 9}]
    (tmp_path / "MANIFEST").write_bytes(formats.encode_manifest(m))
    assert formats.read_manifest(spark, str(tmp_path / "MANIFEST")).first().asDict() == {**m[0], "smallest": bytearray(b"a"), "largest": bytearray(b"e")}


def test_references_to_segments_named_by_nanoseconds(spark):
    refs = [(1_700_000_000_123_456_789, 2, 3, 4), (2**63 - 1, 2**60 + 5, 1, 1)]
    df = spark.createDataFrame([(r,) for r in refs], "vref struct<segment_id:bigint,offset:bigint,value_len:bigint,checksum:bigint>")
    assert all(r.d == r.vref for r in df.select("vref", encoding.decode_vref(encoding.encode_vref("vref")).alias("d")).collect())


def test_reference_codec_and_integrity(spark):
    refs = [(1, 2, 3, 4), (2**40, 2**32 + 5, 2**32 - 1, 2**31)]
    df = spark.createDataFrame([(r,) for r in refs], "vref struct<segment_id:bigint,offset:bigint,value_len:bigint,checksum:bigint>")
    out = df.select("vref", encoding.encode_vref("vref").alias("b")).select("vref", "b", encoding.decode_vref("b").alias("d")).collect()
    assert [len(r.b) for r in out] == [20, 24] and all(r.d == r.vref for r in out)
    blobs = spark.createDataFrame([(1, 0, b"k", b"v", 1)], "segment_id bigint, offset bigint, key binary, value binary, checksum bigint")
    assert values.damaged(blobs).count() == 1
    logs = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, True)], "f string, pos int, ok boolean")
    assert sorted((r.f, r.pos) for r in values.valid_prefix(logs, "f").collect()) == [("a", 1), ("b", 1)]


def test_only_the_newest_segment_may_be_torn(spark, tmp_path):
    blobs = spark.createDataFrame([(n, o, b"k", bytes([n]) * 30) for n in (3, 4) for o in (0, 43)], "segment_id bigint, offset bigint, key binary, value binary")
    names = formats.write_value_log(blobs, str(tmp_path))
    assert sorted(names) == [f"{n:020d}.vlog" for n in (3, 4)]
    back = formats.read_value_log(spark, str(tmp_path))
    assert sorted((r.segment_id, r.offset, bytes(r.value)) for r in back.collect()) == sorted((r.segment_id, r.offset, bytes(r.value)) for r in blobs.collect())
    sealed, newest = sorted(tmp_path / n for n in names)
    for f in tmp_path.glob(".*.crc"):  # the local file system's own checksums
        f.unlink()
    newest.write_bytes(newest.read_bytes()[:-2])
    assert formats.read_value_log(spark, str(tmp_path)).count() == 3
    sealed.write_bytes(sealed.read_bytes()[:-2])
    with pytest.raises(Exception, match="sealed"):
        formats.read_value_log(spark, str(tmp_path)).count()


def test_runs_are_written_and_read_back(spark, tmp_path):
    rows = [("1.sst", b"k%03d" % i, b"v" * i) for i in range(100)] + [("2.sst", b"a", b"")]
    entries = spark.createDataFrame(rows, "file string, key binary, value binary").repartition(4)
    assert sorted(formats.write_runs(entries, str(tmp_path))) == ["1.sst", "2.sst"]
    assert sorted((r.path[-5:], bytes(r.key), bytes(r.value)) for r in formats.read_runs(spark, str(tmp_path)).collect()) == rows


def test_pack_and_hash_vectors(spark):
    row = spark.range(1).select(encoding.pack(F.lit(2**31 - 1), F.lit(2**32 - 1)).alias("p")).select("p", *encoding.unpack("p")).first()
    assert tuple(row) == ((2**31 - 1) << 32 | 2**32 - 1, 2**31 - 1, 2**32 - 1)
    # Published test vectors of the hash: the empty input with seed 0, and with the first 64-bit prime seed of its test suite.
    own = bloom.Bloom(64, 1)._hashes([b""])
    assert own[0] == 0x2D06800538D394C2
    assert bloom.Bloom(64, 1, seed=0x9E3779B185EBCA8D)._hashes([b""])[0] == 0xA8A6B918B2F0364A


def test_many_edges_and_empty_buckets(spark):
    keys = spark.createDataFrame([(f"{i:05d}",) for i in range(0, 3000, 7)], "key string")
    t = spark.createDataFrame([(f"{i:05d}",) for i in range(0, 3100, 13)], "target string")
    edges = [f"{i:05d}" for i in range(0, 5000)]
    held = [f"{i:05d}" for i in range(0, 3000, 7)]
    for forward in (True, False):
        for r in seek.seek(t, keys, forward, edges=edges).collect():
            near = [k for k in held if (k >= r.target if forward else k <= r.target)]
            assert r.found == ((min if forward else max)(near) if near else None)
