"""Main text of web pages: page structure, and a host's repeated runs found with suffix arrays.

A tolerant tag scanner cuts a page into blocks and marks each as inside an explicit article (or
main) element, outside one, or in a part that never is main text (navigation, footers, asides,
adverts, notices, forms, comments).  For every host all blocks, of articles too, are concatenated to
token streams and their suffixes sorted, with the longest common prefix of neighbours.  Repeated
runs of RUN tokens or more decide, whatever element they are in:

* outside articles, runs that stand in two or more distinct pages of the host are its boilerplate.
  A block of fewer tokens is a run only as a whole, and only on MANY pages and SHARE of the host's:
  phrases, quotes and headings that a few pages share stay;
* inside articles, runs that stand in MANY distinct articles and SHARE of the host's are: a notice or
  advert without a telling element or class.  Text that fewer articles share stays.  So does all of
  an article that such runs cover by half or more: it is a copy of others, not a frame around a text.

Tokens covered by boilerplate are removed and the unique runs kept: of a page with an explicit
article those of the article, else those of the blocks that may be main text.

Scale: pages are scanned where they are read; equal articles of a host, and equal rests of its pages,
count once.  They are dealt into parts of about PART_TOKENS tokens; a task sorts the suffixes of one
part.  The hashes of a part's runs outside articles are sent, packed, to one of as many buckets as the
host has parts, so a run is found though no part holds it twice.  What stands in a SHARE of a host
stands in that share of one of its parts at least: only those short blocks and runs in articles are
sent, and where a host has several parts they are then counted in each.  A host with a third of all
pages is spread over all tasks.  Runs that are boilerplate go back to the parts.

Defined results: null or blank html gives an empty text; a null or odd url is a host of its own
spelling; copies of one page count as one page, so a page is not its own boilerplate; repeated
rows give equal rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import html as entities
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import beside, cut, flagged, table

#: Tokens of the shortest repeated run that counts.
RUN = 32
#: Tokens, about, of a host whose suffixes a task sorts together.
PART_TOKENS = 200_000
#: Bytes of html, about, for each token of a page.
TOKEN_BYTES = 8
#: Distinct pages, and share of the host's, on which a whole block of fewer tokens counts; so for articles and runs in them.
MANY, SHARE = 3, 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "object", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset("head nav footer aside form button select menu dialog fieldset label audio video canvas map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice "
    "notices notification notifications alert popup modal overlay comment comments commentlist discussion disqus replies reply newsletter subscribe "
    "subscription signup login paywall breadcrumb breadcrumbs pagination pager related recommended recommendations outbrain taboola widget widgets "
    "skip skiplink".split()
)
_SITE = frozenset("sidebar sidenav menu nav navbar navigation topbar masthead footer header banner social share sharing toolbar".split())
_MAIN = frozenset("content article body entry story main post text".split())
_SPLIT = re.compile(r"[^a-z0-9]+")


def _never_main(name: str, attrs: str, inside: bool) -> bool:
    if name in _NEVER or (name == "header" and not inside):
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    marks: set[str] = set()
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key in ("class", "id"):
            marks.update(_SPLIT.split(value))
        elif key == "role" and value in _ROLES or key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        elif key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(marks & _WORDS) or (bool(marks & _SITE) and not marks & _MAIN)


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, place) of a page's blocks in order: 2 inside an article, 1 outside, 0 never main text."""
    out: list[tuple[str, int]] = []
    if not page:
        return out
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # (element, 2 opens an article, 0 is never main text, 1 else)
    articles = nevers = 0
    at, find, end = 0, _TOKEN.search, len(page)

    def close() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, 0 if nevers else 2 if articles else 1))

    while at < end:
        m = find(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in _BLOCK:
            close()
        elif name == "br":
            held.append(" ")
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    for _, kind in stack[i:]:
                        articles -= kind == 2
                        nevers -= kind == 0
                    del stack[i:]
                    break
            continue
        if name in _RAW:
            stop = _RAW[name].search(page, at)
            at = stop.end() if stop else end
            continue
        if name in _VOID or m[3].endswith("/"):
            continue
        if name == "p" or name == "li":  # opens after an open one of its kind: that one ends
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name and not any(k != 1 for _, k in stack[i:]):
                    del stack[i:]
                    break
                if stack[i][0] in _BLOCK and stack[i][0] != "p":
                    break
        kind = 0 if _never_main(name, m[3], articles > 0) else 2 if name in ("article", "main") or 'articlebody"' in m[3].lower() else 1
        articles += kind == 2
        nevers += kind == 0
        stack.append((name, kind))
    close()
    return out


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes in order, and the length of each one's common prefix with the one before.

    Ranks by the first 1, 2, 4, ... tokens, until they differ; the same ranks, from long to short, give
    the prefixes.
    """
    n, levels = len(tokens), [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    while levels[-1].max(initial=0) < n - 1:
        step = 1 << len(levels) - 1
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = levels[-1][step:] + 1
        levels.append(np.unique(levels[-1] * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64))
    order, common = np.argsort(levels[-1]), np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) + (1 << k) <= n
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        common[1:] += same << k
        a += same << k
        b += same << k
    return order, common


class Streams:
    """The concatenated token streams of pages, and their repeated runs.

    ``group`` has, for every start of a run of RUN tokens within a block, a number that equal runs share (else -1).
    ``articles`` says which pages are articles (none, if left out); the others are what stands outside.
    """

    def __init__(self, pages: list[list[list[str]]], run: int = RUN, articles: list[bool] | None = None):
        self.run, self.n, ids = run, len(pages), {}
        self.articles = np.array(articles or [False] * len(pages), bool)
        flat, self.page, self.left, self.blocks = [], [], [], []
        for p, blocks in enumerate(pages):
            for block in blocks:
                self.blocks.append((p, len(flat), len(block)))
                flat += [ids.setdefault(t, len(ids)) for t in block]
                flat.append(-1 - len(self.blocks))  # ends the block; no other has this token
                self.page += [p] * (len(block) + 1)
                self.left += range(len(block), -1, -1)
        self.words, self.page, self.left = list(ids), np.array(self.page, np.int64), np.array(self.left, np.int64)
        self.tokens = np.array(flat, np.int64)
        order, common = suffix_array(self.tokens)
        number = np.cumsum(common < run)
        self.group = np.full(len(flat), -1, np.int64)
        whole = self.left[order] >= run
        self.group[order[whole]] = number[whole]

    def starts(self, inside: bool) -> np.ndarray:
        """Where runs of RUN tokens start, inside articles or outside."""
        return np.flatnonzero((self.group >= 0) & (self.articles[self.page] == inside))

    def named(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the numbers of the groups that start there, the hash of each one's run by its content), by group number."""
        numbers, first = np.unique(self.group[starts], return_index=True)
        starts = starts[first]
        words = np.array([_hash(w) for w in self.words], np.int64).view(np.uint64)
        out = np.zeros(len(starts), np.uint64)
        for k in range(self.run if len(starts) else 0):
            out = _mixed(out * _MIX + words[self.tokens[starts + k]])
        return numbers, out.view(np.int64)

    def covered(self, hit: np.ndarray) -> np.ndarray:
        """Which tokens lie in a run that starts at one of the marked places."""
        change = np.zeros(len(self.tokens) + self.run + 1, np.int64)
        np.add.at(change, np.flatnonzero(hit), 1)
        np.add.at(change, np.flatnonzero(hit) + self.run, -1)
        return np.cumsum(change)[: len(self.tokens)] > 0

    def marks(self, long: set[int], short: set[int], inside: set[int] = frozenset()) -> list[list[np.ndarray]]:
        """For each page's blocks, which tokens are covered by the runs (by hash) in long, or whole as those in short are.

        For articles, those covered by the runs in inside."""
        hit = np.zeros(len(self.tokens), bool)
        for article, wanted in ((False, long), (True, inside)):
            starts = self.starts(article) if wanted else []
            if len(starts):
                numbers, names = self.named(starts)
                bad = numbers[np.isin(names, np.fromiter(wanted, np.int64, len(wanted)))]
                hit[starts[np.isin(self.group[starts], bad)]] = True
        cover = self.covered(hit)
        out: list[list[np.ndarray]] = [[] for _ in range(self.n)]
        for p, at, n in self.blocks:
            whole = n < self.run and not self.articles[p] and self.block_hash(at, n) in short
            out[p].append(np.ones(n, bool) if whole else cover[at : at + n])
        return out

    def block_hash(self, at: int, n: int) -> int:
        return _hash(" ".join(self.words[t] for t in self.tokens[at : at + n].tolist()))

    def runs(self, keys: list[int]) -> list[tuple[int, bool, int, int, int]]:
        """(hash, short, least key, greatest key, pages) of every run and short block outside articles, keys naming the pages."""
        names, lo, hi = self.long_runs(keys)
        return [(h, False, a, b, 0) for h, a, b in zip(names.tolist(), lo.tolist(), hi.tolist(), strict=True)] + [(h, True, 0, 0, n) for h, n in self.short_blocks()]

    def long_runs(self, keys: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes of the runs outside articles, and the least and greatest of the keys of their pages."""
        held, key = self.starts(False), np.array(keys, np.int64)
        if not len(held):
            return (np.zeros(0, np.int64),) * 3
        _, names = self.named(held)
        held = held[np.argsort(self.group[held], kind="stable")]
        edges = np.flatnonzero(np.diff(self.group[held], prepend=-1))
        return names, np.minimum.reduceat(key[self.page[held]], edges), np.maximum.reduceat(key[self.page[held]], edges)

    def short_blocks(self) -> list[tuple[int, int]]:
        """(hash, pages) of every block outside articles that is shorter than a run."""
        short = Counter({(self.block_hash(at, n), p) for p, at, n in self.blocks if 0 < n < self.run and not self.articles[p]})
        return list(Counter(h for h, _ in short).items())

    def shared(self, least: float) -> list[tuple[int, int]]:
        """(hash, articles) of every run that stands in so many articles."""
        starts = self.starts(True)
        pairs = np.unique(self.group[starts] * max(self.n, 1) + self.page[starts]) // max(self.n, 1)
        numbers, counts = np.unique(pairs, return_counts=True)
        often = counts >= least
        if not often.any():
            return []
        _, names = self.named(starts[np.isin(self.group[starts], numbers[often])])
        return list(zip(names.tolist(), counts[often].tolist(), strict=True))


def _needs(page: list[tuple[str, int]]) -> bool:
    return not any(place == 2 for _, place in page)


def _article(page: list[tuple[str, int]]) -> str:
    return "\n".join(text for text, place in page if place == 2)


def _outside(page: list[tuple[str, int]]) -> str:
    """The blocks of a page outside articles, one a line, each after its place."""
    return "\n".join(f"{place}{text}" for text, place in page if place < 2)


def _inside(page: list[tuple[str, int]]) -> str:
    """The blocks of a page's article, so."""
    return "\n".join(f"2{text}" for text, place in page if place == 2)


def _of(blocks: str) -> list[list[str]]:
    """The tokens of each of ``_outside``'s or ``_inside``'s blocks."""
    return [line[1:].split() for line in blocks.split("\n")] if blocks else []


def _uncovered(blocks: str, marks: list[np.ndarray]) -> str:
    """What of blocks that may be main text is not covered; an article that is covered by half or more stays."""
    article = blocks[:1] == "2"
    if article and 2 * sum(int(m.sum()) for m in marks) >= sum(map(len, marks)):
        marks = [np.zeros(len(m), bool) for m in marks]
    kept = []
    for line, covered in zip(blocks.split("\n") if blocks else (), marks, strict=True):
        unique = [w for w, c in zip(line[1:].split(), covered.tolist(), strict=True) if not c]
        if unique and line[0] != "0":
            kept.append(" ".join(unique))
    return "\n".join(kept)


def main_texts(pages: list[list[tuple[str, int]]]) -> list[str]:
    """The main text of each of one host's pages, given as their blocks; all at once."""
    outside = list(dict.fromkeys(map(_outside, pages)))
    articles = list(dict.fromkeys(_inside(p) for p in pages if not _needs(p)))
    held = outside + articles
    streams = Streams([_of(h) for h in held], articles=[k >= len(outside) for k in range(len(held))])
    runs = streams.runs(list(range(len(held))))
    short = {h for h, s, _, _, n in runs if s and n >= MANY and n >= SHARE * len(outside)}
    inside = {h for h, _ in streams.shared(max(MANY, SHARE * len(articles)))}
    texts = {h: _uncovered(h, m) for h, m in zip(held, streams.marks({h for h, s, lo, hi, _ in runs if not s and lo < hi}, short, inside), strict=True)}
    return [texts[_outside(p) if _needs(p) else _inside(p)] for p in pages]


#: Kinds of rows that tell of runs: long ones outside articles, short blocks there, runs in articles, and a part's numbers.
_LONG, _SHORT, _INSIDE, _PART = range(4)


def _key(blocks: str) -> bytes:
    return hashlib.blake2b(blocks.encode("utf-8", "replace"), digest_size=16).digest()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, whether a page is without article, blocks) of the articles and of what stands outside, once a task."""
    seen: set[tuple] = set()
    for b in batches:
        out = []
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = blocks(page)
            need = _needs(found)
            for held in (_outside(found),) if need else (_outside(found), _inside(found)):
                own = _key(held)
                if (host, own, need) not in seen:
                    seen.add((host, own, need))
                    out.append((host, own, need, zlib.compress(held.encode("utf-8", "replace"), 1)))
        kinds = (pa.string(), pa.binary(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["host", "own", "need", "blocks"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list, list]]:
    """(host, part, parts of the host, [key, need, blocks] of each text, (kind, run or bucket, packed runs) told to the part) in turn; a task holds one part."""
    rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
    for (host, part), own in itertools.groupby(rows, lambda r: (r[0], r[1])):
        texts, told, parts = [], [], 1
        for _, _, parts, key, need, packed, kind, run in own:
            if key is None:
                told.append((kind, run, packed))
            elif texts and texts[-1][0] == key:
                texts[-1][1] |= need
            else:
                texts.append([key, need, zlib.decompress(packed).decode()])
        yield host, part, parts, texts, told


def _streams(texts: list) -> Streams:
    return Streams([_of(t) for _, _, t in texts], articles=[t[:1] == "2" for _, _, t in texts])


_RUNS = "host string, part int, parts int, kind int, run bigint, articles bigint, needs bigint, n bigint, packed binary"


def _run_rows(host: str, part: int, parts: int, rows: list) -> pa.RecordBatch:
    rows = [(host, part, parts, *r) for r in rows]
    kinds = (pa.string(), *[pa.int32()] * 3, *[pa.int64()] * 4, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _RUNS.split(", ")])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part, its runs outside articles, and what stands in a SHARE of it.

    The runs of a host of one part are those on two pages; of others, all by buckets, those on two pages marked."""
    for host, part, parts, texts, _ in _parts(batches):
        streams, least = _streams(texts), MANY if parts == 1 else 1
        articles, needs = int(streams.articles.sum()), sum(need for _, need, _ in texts)
        pages = len(texts) - articles
        rows = [(_PART, 0, articles, needs, pages, None)]
        if parts > 1 or needs:
            names, lo, hi = streams.long_runs(list(range(len(texts))))
            twice = lo < hi
            if parts == 1:
                names, twice = names[twice], twice[twice]
            bucket = names % parts
            order = np.argsort(bucket, kind="stable")
            names, twice, (held, counts) = names[order], twice[order], np.unique(bucket, return_counts=True)
            for number, end, n in zip(held.tolist(), np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                at = end - n
                rows.append((_LONG, number, 0, 0, n, names[at:end].astype("<i8").tobytes() + twice[at:end].tobytes()))
        rows += [(_SHORT, h, 0, 0, n, None) for h, n in streams.short_blocks() if n >= max(least, SHARE * pages)]
        rows += [(_INSIDE, h, 0, 0, n, None) for h, n in streams.shared(max(least, SHARE * articles))]
        yield _run_rows(host, part, parts, rows)


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket of a host's runs, those on two pages, for each part that has some; other parts have other pages."""
    rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
    for (host, bucket), own in itertools.groupby(rows, lambda r: (r[0], r[1])):
        own = list(own)
        names = [np.frombuffer(r[5], "<i8", r[4]) for r in own]
        marks = np.concatenate([np.frombuffer(r[5], bool, r[4], 8 * r[4]) for r in own])
        found, at, parts = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        bad = parts > 1
        bad[at[marks]] = True
        out = []
        for (_, _, part, parts, _, _), held in zip(own, names, strict=True):
            hit = held[bad[np.searchsorted(found, held)]]
            if len(hit):
                out.append((host, part, parts, bucket, hit.tobytes()))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["host", "part", "parts", "run", "blocks"])


def _told(told: list, kind: int) -> set[int]:
    """The runs of a kind among those told to a part."""
    return {h for k, run, packed in told if k == kind for h in (np.frombuffer(packed, "<i8").tolist() if packed is not None else (run,))}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many pages or articles of each part the short blocks and runs told to it stand."""
    for host, part, parts, texts, told in _parts(batches):
        streams, short, inside = _streams(texts), _told(told, _SHORT), _told(told, _INSIDE)
        rows = [(_SHORT, h, 0, 0, n, None) for h, n in streams.short_blocks() if h in short] if short else []
        rows += [(_INSIDE, h, 0, 0, n, None) for h, n in streams.shared(1) if h in inside] if inside else []
        yield _run_rows(host, part, parts, rows)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, unique) of the pages without article, and of the articles that runs told to their part change."""
    for host, _, _, texts, told in _parts(batches):
        long, short, inside = (_told(told, kind) for kind in (_LONG, _SHORT, _INSIDE))
        out = []
        for (key, need, held), marks in zip(texts, _streams(texts).marks(long, short, inside), strict=True):
            if need or (held[:1] == "2" and any(m.any() for m in marks)):
                out.append((host, key, _uncovered(held, marks)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.binary(), pa.string()))], names=["host", "own", "unique"])


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    kinds = [df.schema[c].dataType.simpleString() for c in (page_id, url)]
    source = df.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    host = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^(?i)www\.", ""))
    source = source.withColumn("host", host)

    # Parts of the hosts that have more than one.
    part_bytes = TOKEN_BYTES * PART_TOKENS
    sizes = cut(source.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes")))
    large = cut(sizes.where(F.col("bytes") > part_bytes).select("host", F.ceil(F.col("bytes") / part_bytes).cast("int").alias("parts")))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, (sizes.agg(F.sum("bytes")).first()[0] or 0) // (16 * part_bytes))

    def parts(pages: DataFrame, told: DataFrame | None = None) -> DataFrame:
        """The texts of pages in the order of their parts, after the (host, part, parts, kind, run, packed runs as blocks) told to them."""
        held = beside(pages.select("host", "html").mapInArrow(_pack, "host string, own binary, need boolean, blocks binary"), large, "host", "left")
        held = held.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("own"), "parts").cast("int"))
        held = held.select("host", "part", "parts", "own", "need", "blocks", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("bigint").alias("run"))
        if told is not None:
            held = held.unionByName(told, allowMissingColumns=True)
        return held.repartition(tasks, "host", "part").sortWithinPartitions("host", "part", "own")

    def everywhere(found: DataFrame) -> DataFrame:
        """(host, parts, kind, run) for each part of the host."""
        return found.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("host", "part", "parts", "kind", "run")

    runs = cut(parts(source).mapInArrow(_find, _RUNS))
    totals = runs.where(F.col("kind") == _PART).groupBy("host").agg(F.sum("n").alias("pages"), F.sum("articles").alias("articles"), F.sum("needs").alias("needs"))
    totals = cut(totals)
    needy = cut(totals.where("needs > 0").select("host"))

    # Short blocks and runs in articles that a part holds often: counted in all parts where those that hold them often don't settle it.
    often = runs.where(F.col("kind").isin(_SHORT, _INSIDE)).select("host", "parts", "kind", "run", "n")
    often = beside(often, totals, "host").where((F.col("kind") == _INSIDE) | (F.col("needs") > 0))
    whole = F.when(F.col("kind") == _SHORT, F.col("pages")).otherwise(F.col("articles"))
    enough = (F.col("n") >= MANY) & (F.col("n") >= SHARE * F.col("whole"))
    often = cut(often.groupBy("host", "parts", "kind", "run", whole.alias("whole")).agg(F.sum("n").alias("n")))
    found, several = often.where(enough), cut(often.where(~enough & (F.col("parts") > 1) & (F.col("whole") >= MANY)))
    if not several.isEmpty():
        again = flagged(source, several.select("host").distinct(), ["host"], "told").where("told")
        again = parts(again, everywhere(several)).mapInArrow(_count, _RUNS).groupBy("host", "kind", "run").agg(F.sum("n").alias("n"))
        found = found.unionByName(several.drop("n").join(again, ["host", "kind", "run"]).where(enough))
    found = cut(found.select("host", "parts", "kind", "run"))

    hosts = cut(needy.union(found.where(F.col("kind") == _INSIDE).select("host")).distinct())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = [blocks(h) for h in b.column(2).to_pylist()]
            keys = [_key(_outside(p) if _needs(p) else _inside(p)) for p in pages]
            cols = [b.column(0), b.column(1), b.column(3), pa.array(keys, pa.binary()), pa.array([_article(p) for p in pages], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "host", "own", "text"])

    def scanned(pages: DataFrame) -> DataFrame:
        return pages.select("page_id", "url", "html", "host").mapInArrow(scan, f"page_id {kinds[0]}, url {kinds[1]}, host string, own binary, text string")

    if hosts.isEmpty():
        return scanned(source).select("page_id", "url", "text")

    # Long runs go to the parts that hold them, the others to all of the host.
    long = beside(runs.where(F.col("kind") == _LONG), needy, "host", "left_semi").select("host", "run", "part", "parts", "n", "packed")
    long = long.repartition(tasks, "host", "run").sortWithinPartitions("host", "run").mapInArrow(_twice, "host string, part int, parts int, run bigint, blocks binary")
    told = long.withColumn("kind", F.lit(_LONG)).unionByName(everywhere(found), allowMissingColumns=True)
    marked = flagged(source, hosts, ["host"], "hot")
    texts = parts(marked.where("hot"), told).mapInArrow(_finish, "host string, own binary, unique string")
    made = scanned(marked.where("hot")).join(texts, ["host", "own"], "left").select("page_id", "url", F.coalesce("unique", "text").alias("text"))
    return scanned(marked.where("not hot")).select("page_id", "url", "text").unionByName(made)


def query(spark, sf_dir):
    """op9: the whole of pages."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
