import hashlib
import struct
from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
from strata.llm import bpe, mixing  # noqa: E402
from strata.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "secret scan", "source mixing", "byte-level BPE"]
    assert [q.split("_")[0] for q in QUERIES] == [f"op{i}" for i in range(1, 11)] and set(ORACLE_SQL) <= set(QUERIES)


def test_run_against_its_parts(spark, tmp_path):
    clean = [
        (i, " ".join(f"the word{i}x{j}" for j in range(40)) + (' token = "0123456789abcdef0123456789abcdef01234567"' if i == 4 else ""), "en", f"s{i % 3}", 1)
        for i in range(30)
    ]
    docs = clean + [(100, clean[0][1] + " end", "en", "s1", 1), (101, clean[0][1], "en", "s1", 1), (102, "too short", "en", "s1", 1), (103, None, None, None, None), (104, " ".join(f"s{j}###" for j in range(80)), "en", "s0", 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    state = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:2]:
        state = stage(spark, state, str(tmp_path))
    assert sorted(r.doc_id for r in state.collect()) == list(range(30))
    state = corpus_pipeline.redact(spark, state, "")
    texts = {r.doc_id: r.text for r in state.collect()}
    assert "0123456789abcdef" not in texts[4] and "[secret]" in texts[4] and texts[5] == clean[5][1]
    mixed = corpus_pipeline.balance(spark, state, "")
    ids = {r.doc_id for r in mixed.collect()}
    p = {r.doc_id: r.probability for r in mixing.mix(state).collect()}
    u = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32 for i in p}
    assert ids == {i for i in p if u[i] < p[i]}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == ids
    with Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).open("rb") as f:
        lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    for r in rows:
        want = lib.encode_ordinary(texts[r.doc_id])
        assert r.ids == want and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        docs = out if "text" in out.columns else docs
