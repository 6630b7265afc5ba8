import random

import pytest

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from strata.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def pair():
    with open(tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        own = bpe.encoder(f.read(), tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


ALPHABET = [*"abc   \n\t'sétđ日本語12٣#!  \x1c\x85​　İſ🙂é the ing", "re", " the", "  ", "123"]


def test_same_ids_as_the_library_and_exact_round_trip(pair):
    own, lib = pair
    rng = random.Random(1)
    texts = ["", " ", "\n\n", "a" * 50_000, " " * 5_000, *("".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(3000))]
    for t in texts:
        ids = own.encode(t)
        assert ids == lib.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_neighbour_rule_agrees_with_merging(pair):
    own, _ = pair
    rng = random.Random(2)
    for _ in range(20_000):
        a, b = rng.randrange(3000), rng.randrange(3000)
        assert own.beside(a, b) == (own.merge(own.tokens[a] + own.tokens[b]) == [a, b])


def test_appends_and_edits_follow_the_text(pair):
    own, lib = pair
    rng = random.Random(3)
    for _ in range(300):
        s = "".join(rng.choices(ALPHABET, k=rng.randint(0, 30)))
        held = bpe.EncodedText(own, s)
        for _ in range(4):
            m = "".join(rng.choices(ALPHABET, k=rng.randint(0, 6)))
            if rng.random() < 0.5:
                held.append(m)
                s += m
            else:
                a = rng.randint(0, len(s))
                b = rng.randint(a, min(len(s), a + 5))
                held.edit(a, b, m)
                s = s[:a] + m + s[b:]
            assert held.text == s and held.ids() == lib.encode_ordinary(s)


def test_column_with_nulls_copies_and_other_columns(spark, pair):
    _, lib = pair
    df = spark.createDataFrame([(1, None, "x"), (None, "the cat", "y"), (3, "", None), (3, "the cat", "z")], "doc_id bigint, text string, Text2 string")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.encode_column(df, path, tokenizers.PATTERN).collect()
    assert [r.ids for r in rows] == [[], lib.encode_ordinary("the cat"), [], lib.encode_ordinary("the cat")]
    assert [r.n_tokens for r in rows] == [len(r.ids) for r in rows]
    back = bpe.decode_column(bpe.encode_column(df, path, tokenizers.PATTERN, digests=False), path).collect()
    assert [bytes(r.decoded) for r in back] == [b"", b"the cat", b"", b"the cat"]
    assert bpe.encode_column(df.limit(0), path, tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="taken"):
        bpe.encode_column(df.withColumn("IDS", df.doc_id), path, tokenizers.PATTERN)
