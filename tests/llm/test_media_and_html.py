import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from strata.llm import html_text, media


def payloads():
    rng = random.Random(1)
    sine = bytes(128 + int(60 * math.sin(i / 20)) for i in range(64 * 40))
    return [
        bytes(64), b"a" * 64, rng.randbytes(64 * 50), bytes(rng.choices(range(120, 136), k=64 * 33)), sine, b"\x00\xff" * 640, bytes(range(256)) * 16,
        *[media._payload(t) for t in (None, "", "hi", "é" * 700, "the cat sat on the mat. " * 900)],
    ]


def test_flac_round_trip_checksums_and_seeks():
    made = payloads()
    streams = media.encode_many(made)
    assert media.decode_many(streams) == made
    assert [media.encode_many([p])[0] for p in made] == streams
    for p, s in zip(made, streams, strict=True):
        assert s[:4] == b"fLaC" and media.read_samples(s, 70, 5000) == p[70:5070] and media.read_samples(s, len(p) + 5, 9) == b""
        for at in {len(s) - 1, len(s) - 20, len(s) // 2 + 40} & set(range(60, len(s))):
            broken = bytearray(s)
            broken[at] ^= 4
            with pytest.raises((media.Broken, IndexError, KeyError, ValueError)):
                media.decode_many([bytes(broken)])


def test_streams_without_seek_points_and_linear_predictors():
    made = payloads()
    for p, s in zip(made, media.encode_many(made), strict=True):
        n = int.from_bytes(s[43:46], "big")
        bare = s[:4] + b"\x80" + s[5:42] + s[46 + n :]
        assert media.decode_many([bare]) == [p]
    kinds = set()
    for s in media.encode_many(made):
        first = media._open(s)[5]
        kinds.add(media._frame(s, first, 8)[1:2] + (len(media._frame(s, first, 8)[3]),))
    assert (0, 0) in kinds and (1, 0) in kinds and (2, 2) in kinds


def test_media_columns(spark):
    texts = [None, "", "hello", "x" * 5000, "hello"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, PCM int")
    back = media.from_media(media.to_media(df))
    rows = back.orderBy("doc_id").collect()
    assert [bytes(r.payload) for r in rows] == [media._payload(t) for t in texts] and rows[2].media == rows[4].media
    blocks = media.pcm_blocks(back, samples=2048).orderBy("doc_id", "block").collect()
    assert [(r.sample_offset, r.n_samples) for r in blocks if r.doc_id == 3] == [(0, 2048), (2048, 2048), (4096, 960)]
    assert b"".join(bytes(r.pcm) for r in blocks if r.doc_id == 3) == media._payload(texts[3])
    assert media.to_media(df.limit(0)).count() == 0
    x = np.frombuffer(media._payload("hello"), np.uint8)
    assert media.feature(x.tobytes()).startswith("samples=64;")
    assert hashlib.sha256(bytes(rows[0].payload)).hexdigest() == hashlib.sha256(bytes(64)).hexdigest()


def test_digests_against_the_libraries(spark):
    texts = [None, "", "hello", "é" * 5000, "the cat " * 40_000, "hello"]
    df = spark.createDataFrame([(i, t, "m", "p") for i, t in enumerate(texts)], "doc_id int, text string, media string, payload string")
    stored = media.to_media(df)
    assert stored.columns == ["doc_id", "text", "media", "payload", "media_"]
    streams = {r.doc_id: bytes(r["media_"]) for r in stored.collect()}
    held = stored.selectExpr("doc_id", "CAST(coalesce(octet_length(text), 0) AS BIGINT) AS n_bytes", "media_ AS media")
    rows = {r.doc_id: r for r in media.digests(held).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        data += bytes(-len(data) % 64 or (0 if data else 64))
        x = np.frombuffer(data, np.uint8).astype(int) - 128
        level = int(np.abs(x).sum()) * 1000 // len(x)
        want = f"samples={len(x)};peak={np.abs(x).max()};level={level};crossings={sum((a < 0) != (b < 0) for a, b in itertools.pairwise(x.tolist()))}"
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature, r.pcm_blocks) == (len(streams[i]), hashlib.sha256(streams[i]).hexdigest(), want, -(-len(data) // media.PCM))


def text_of(html):
    return html_text.main_texts([html_text.blocks(html)])[0]


def test_blocks():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='</p><article>';</script></head><body><header>Site</header><nav><ul><li>Menu</li></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><article><header><h1>Title &amp; more</h1></header><p>One  two\n three&nbsp;four<p>Five<br>six <b>seven"
        "<p>a &lt;b&gt; c</p><div class='ad'>Buy</div><aside>See also</aside><form><p>Name</p></form><ul><li>x<li>y</ul><table><tr><td>1<td>2</table>"
        "<!-- <p>no</p> --><style>p{}</style><section id=comments><p>Nice!</p></section><p hidden>secret</p><footer>by me</footer></article><aside>side</aside><footer>(c)</footer></body>"
    )
    assert text_of(page) == "Title & more\nOne two three four\nFive six seven\na <b> c\nx\ny\n1\n2"
    assert text_of(None) == "" and text_of("") == "" and text_of("plain words") == "plain words" and text_of("<script>never closed") == ""
    assert text_of("<main><p>M</p></main><p>out</p>") == "M" and text_of("<article><p>a < b and c > d</p>") == "a < b and c > d"


def test_repeated_runs_of_a_host_go(spark):
    menu, foot = "<div>Home News Sport Weather Contact</div>", "<div>All rights reserved by the host company</div>"
    pages = [(i, f"https://www.h.example/{i}", f"{menu}<p>Story number {i} tells of item{i} alone item{i * 7 + 1}.</p>{foot}", "z") for i in range(300)]
    pages += [(900, "https://one.example", f"{menu}<p>Only page here.</p>", "z")] * 3 + [(901, None, None, "z"), (902, "", "<article><p>A</p></article>", "z")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, PART string")
    rows = html_text.extract(df).collect()
    assert len(rows) == 305
    got = {r.page_id: r.text for r in rows}
    assert got[7] == "Story number 7 tells of item7 alone item50." and got[900] == "Home News Sport Weather Contact\nOnly page here." and got[901] == "" and got[902] == "A"
    assert html_text.extract(df.limit(0)).count() == 0


def test_runs_are_counted_over_the_whole_host(spark):
    run = " ".join(f"shared{k}" for k in range(40))
    pages = [(i, f"https://big.example/{i}", f"<p>Own{i} a{i} b{i} c{i}</p>" + (f"<p>{run}</p>" if i % 150 == 0 else "")) for i in range(1500)]
    rows = html_text.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {i: f"Own{i} a{i} b{i} c{i}" for i in range(1500)}


def test_common_phrases_and_headings_stay(spark):
    quote = "as the minister said on the same day in the house"
    pages = [(i, f"https://prose.example/{i}", f"<div>Home News Sport</div><h2>{'Background' if i % 4 == 0 else f'Part {i}'}</h2><p>Page{i} tells, {quote}, of item{i}.</p>") for i in range(40)]
    rows = html_text.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {i: f"{'Background' if i % 4 == 0 else f'Part {i}'}\nPage{i} tells, {quote}, of item{i}." for i in range(40)}


def test_suffix_array_against_sorting():
    rng = random.Random(6)
    for n in (0, 1, 2, 40, 200):
        t = [rng.choice((0, 0, 0, 1)) for _ in range(n)] + [-1]
        order, common = html_text.suffix_array(np.array(t))
        want = sorted(range(n + 1), key=lambda i: t[i:])
        assert order.tolist() == want
        assert common.tolist() == [0] + [next(k for k in range(n + 2) if t[a + k : a + k + 1] != t[b + k : b + k + 1]) for a, b in itertools.pairwise(want)]


def test_suffix_runs_against_brute_force():
    rng = random.Random(3)
    pages = [[[rng.choice("abc") for _ in range(rng.randint(1, 30))] for _ in range(2)] for _ in range(6)] + [[]]
    streams = html_text.Streams(pages, 4)
    runs = streams.runs(list(range(len(pages))))
    got = streams.marks({h for h, short, lo, hi, _ in runs if not short and lo < hi}, {h for h, short, _, _, n in runs if short and n >= 2})

    def held(page):
        return {tuple(b[k : k + 4]) for b in page for k in range(len(b) - 3)} | {tuple(b) for b in page if len(b) < 4}

    for i, page in enumerate(pages):
        others = set().union(*(held(o) for j, o in enumerate(pages) if j != i))
        for block, marks in zip(page, got[i], strict=True):
            want = np.zeros(len(block), bool)
            for a in range(max(len(block) - 3, 0)):
                want[a : a + 4] |= tuple(block[a : a + 4]) in others
            if len(block) < 4 and tuple(block) in others:
                want[:] = True
            assert (marks == want).all()


def test_parts_of_a_host_agree_with_the_whole(spark, monkeypatch):
    """Real pages without their article elements, in parts of a few pages: as the whole host at once, and not without the runs."""
    folder = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(folder):
        pytest.skip("test tables are not there")
    foot = " ".join(f"legal{i}" for i in range(50))
    pages = spark.read.parquet(folder).collect()
    bare = [re.sub("</?article>|</?footer>|</?nav>", "", p.html or "").replace("</body>", f"<p>{foot if i % 3 else ''}</p></body>") for i, p in enumerate(pages)]
    df = spark.createDataFrame([(i, "https://www.One.example/x", h, "h") for i, h in enumerate(bare)], "page_id int, url string, html string, HOST string")
    monkeypatch.setattr(html_text, "PART_TOKENS", 2000)
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    want = dict(enumerate(html_text.main_texts([html_text.blocks(h) for h in bare])))
    assert got == want
    plain = ["\n".join(t for t, place in html_text.blocks(h) if place) for h in bare]
    assert sum(want[i] != plain[i] for i in want) >= len(bare) // 2 and not any("legal7" in t for t in want.values())


def test_very_long_page_and_names(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "https://l.example", f"<p>{long}</p>", "a", 1), (2, "https://l.example", f"<p>{long} end</p>", "b", 2), (3, "https://l.example", f"<article>{long}</article>", "c", 3)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, own string, part int")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {1: "", 2: "end", 3: long}


def article_pages():
    """Pages of one host, all with an article: a notice without a telling element in most, a passage in few, an article with edited copies, a teaser on all."""
    notice, passage, teaser = (" ".join(f"{w}{k}" for k in range(40)) for w in ("notice", "passage", "teaser"))
    pages, want = [], []
    for i in range(30):
        own = " ".join(f"own{i}x{k}" for k in range(120))
        body = teaser if i == 4 else passage if i % 7 == 0 else f"Part {i}"
        pages.append(f"<nav>Home News</nav><article><h1>News</h1><p>{own}</p><div>{notice if i % 5 else ''}</div><p>{body}</p></article><div>{teaser}</div>")
        want.append(f"News\n{own}\n{body}")
    return pages, want


def test_runs_decide_inside_articles(spark, monkeypatch):
    pages, want = article_pages()
    copies = [f"<article><p>{' '.join(f'same{k}' for k in range(60))}</p><p>edited {i}</p></article>" for i in range(6)]
    rows = [(i, "https://a.example/x", h) for i, h in enumerate(pages)] + [(100 + i, "https://copies.example", h) for i, h in enumerate(copies)]
    rows += [(200 + i, "https://a.example/copy", pages[1]) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    texts = dict(enumerate(want)) | {100 + i: text_of(h) for i, h in enumerate(copies)} | {200 + i: want[1] for i in range(40)}
    assert html_text.main_texts([html_text.blocks(h) for h in pages]) == want and any("notice7" in text_of(h) for h in pages)
    for size in (200_000, 1000):  # one part, and several
        monkeypatch.setattr(html_text, "PART_TOKENS", size)
        assert {r.page_id: r.text for r in html_text.extract(df).collect()} == texts


def test_runs_in_articles_against_brute_force():
    rng = random.Random(5)
    pages = [[[rng.choice("ab") for _ in range(rng.randint(1, 9))] for _ in range(2)] for _ in range(12)] + [[]]
    inside = [p % 3 > 0 for p in range(len(pages))]
    streams = html_text.Streams(pages, 4, inside)

    def held(page):
        return {tuple(b[k : k + 4]) for b in page for k in range(len(b) - 3)}

    for least in (1, 3):
        runs = [r for r in set().union(*map(held, pages)) if sum(r in held(p) for p, a in zip(pages, inside, strict=True) if a) >= max(least, 1)]
        found = streams.shared(least)
        assert sorted(n for _, n in found) == sorted(sum(r in held(p) for p, a in zip(pages, inside, strict=True) if a) for r in runs)
        for page, article, marks in zip(pages, inside, streams.marks(set(), set(), {h for h, _ in found}), strict=True):
            for block, got in zip(page, marks, strict=True):
                want = np.zeros(len(block), bool)
                for a in range(len(block) - 3):
                    want[a : a + 4] |= article and tuple(block[a : a + 4]) in runs
                assert (got == want).all()
