"""Byte-level BPE by prefix dynamic programming.

A byte string has one BPE encoding, and the encoding of a prefix ends in one token.  The table
``last[i]`` holds that token for the prefix of i bytes: of the tokens that end at i, the one whose
start j has a ``last[j]`` it may stand beside.  Two tokens may stand side by side when merging
their joint bytes gives just these two back.  The encoding is read off the table backwards, an
append only extends it, and after an edit only the pieces near it are done again.

A text is split by the vocabulary's pattern first; each match is encoded alone.  Between two
non-blank characters a single space always starts a match, so a text is cut at such spaces and the
parts, which recur, are looked up in a bounded cache.

Defined results: null is the empty text (no tokens); ties, repeated rows and other columns do not
matter, each row is encoded alone; cost is linear in a text's length.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of each kind in a worker's young generation; the last one is kept beside it.  Bounds memory, not results.
CACHE_ENTRIES = 100_000
#: Bytes of a match up to which its prefix table is filled by recursion.
DEEP = 128
#: Texts of a batch that are Python strings at a time.
SLICE = 256
#: Texts of up to so many characters have their parts cached; longer parts are encoded and forgotten.
CACHED_PART = 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file of ``base64(token) rank`` lines."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


class _Cache(dict):
    """key -> value by ``make`` on a miss; when full, it becomes the old generation, whose entries come back when asked for."""

    def __init__(self, make, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PrefixTable:
    """Last tokens of all prefixes of one match; grows by appends."""

    def __init__(self, bpe: ByteBpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        data, last, bpe = self.data, self.last, self.bpe
        ranks, ends, pairs = bpe.inner, bpe.ends, bpe.pairs
        for i in range(start + 1, len(data) + 1):
            for n in ends[data[max(0, i - 4) : i]]:
                j = i - n
                if j < 0:
                    continue
                token = ranks.get(data[j:i])
                if token is not None and (j == 0 or pairs[last[j] << 20 | token]):
                    last.append(token)
                    break

    def ids(self) -> list[int]:
        whole = self.bpe.ranks.get(self.data)
        if whole is not None:
            return [whole]
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.bpe.tokens[self.last[i]])
        return out[::-1]


def _last_token(ends, inner, pairs):
    """The function that finds the last token of a prefix of i bytes; last holds those found so far."""
    token_of = inner.get

    def last_token(data: bytes, i: int, last: list[int]) -> int:
        for n in ends[data[i - 4 : i] if i > 4 else data[:i]]:
            j = i - n
            if j > 0:
                token = token_of(data[j:i])
                if token is not None:
                    before = last[j]
                    if before < 0:
                        before = last_token(data, j, last)
                    if pairs[before << 20 | token]:
                        last[i] = token
                        return token
            elif j == 0:
                token = token_of(data[:i])
                if token is not None:
                    last[i] = token
                    return token
        raise ValueError("a byte has no token")

    return last_token


class ByteBpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.tokens = ranks, {r: t for t, r in ranks.items()}
        # White space by its Unicode property, as the vocabularies' own library has it.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        # Each token's last merge, and the tokens that merging can reach; others only ever stand for a whole match.
        self.halves, self.inner = {}, {}
        for t, r in ranks.items():
            parts = self.merge(t, r)
            if len(parts) < 3:
                self.halves[r], self.inner[t] = (parts[0], parts[-1]), r
        tails: dict[bytes, set[int]] = {}
        for t in self.inner:
            if len(t) > 3:
                tails.setdefault(t[-4:], set()).add(len(t))
        # Lengths of the tokens that can end where these last bytes (up to four) do, long ones first.
        self.ends = _Cache(lambda e: (*sorted(tails.get(e, ()), reverse=True), *(n for n in (3, 2, 1) if n <= len(e) and e[-n:] in self.inner)))
        # All tokens that end at each byte of a string, in one pass; a byte is a character of the automaton.
        self.found = ahocorasick.Automaton()
        for t, r in self.inner.items():
            self.found.add_word(t.decode("latin-1"), (len(t) - 1, r))
        self.found.make_automaton()
        self.pairs = _Cache(lambda k: self.beside(k >> 20, k & 0xFFFFF), 4 * CACHE_ENTRIES)
        self._last = _last_token(self.ends, self.inner, self.pairs)
        self.packs = {r: r.to_bytes(4, "little") for r in self.tokens}
        # Per part of a text: its packed ids, and the bytes that they decode to.
        self._match = _Cache(self._pack)
        self._first = _Cache(self._parts)
        self._after = _Cache(self._spaced)

    def merge(self, data: bytes, below: int = 1 << 40) -> list[int]:
        """Ranks left when the lowest-ranked neighbours, leftmost first, have been merged, by ranks under ``below`` alone; for short strings."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < below and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def beside(self, a: int, b: int) -> bool:
        """True if a text of these two tokens encodes to just them.

        Goes back through the merges that made the two, latest first; they stay apart unless at
        some time the parts on either side of the border could have merged before those did.
        """
        ranks, tokens, halves, before = self.ranks, self.tokens, self.halves, 1 << 40
        while True:
            joint = ranks.get(tokens[a] + tokens[b])
            if joint is not None and joint < before:
                return False
            left, right = len(tokens[a]) > 1, len(tokens[b]) > 1
            if left and (not right or a > b):
                before, a = a, halves[a][1]
            elif right:
                # Of equal ranks the left one merges first, so a joint of b's own rank comes before b.
                before, b = b + 1, halves[b][0]
            else:
                return True

    def _pack(self, match: str) -> tuple[bytes, bytes]:
        """A match's packed ids, and the bytes that they decode to.

        The prefix table of a match that is not kept.  A short one is filled from its end, so only
        the prefixes that some token's start asks for; a long one from its start.
        """
        data, tokens = match.encode(), self.tokens
        whole = self.ranks.get(data)
        if whole is not None:
            return self.packs[whole], tokens[whole]
        i, last = len(data), [-1] * (len(data) + 1)
        if i <= DEEP:
            self._last(data, i, last)
        else:
            pairs = self.pairs
            for end, (more, token) in self.found.iter(data.decode("latin-1")):
                if last[end + 1] < 0:  # one token alone can be a prefix's last
                    start = end - more
                    if start == 0 or pairs[last[start] << 20 | token]:
                        last[end + 1] = token
        out = []
        while i:
            out.append(last[i])
            i -= len(tokens[last[i]])
        out.reverse()
        return array("I", out).tobytes(), b"".join([tokens[t] for t in out])

    def _spaced(self, part: str) -> tuple[bytes, bytes] | None:
        """A part between spaces, with the one before it; None if a space beside it has another blank beside it."""
        if part.isalpha():
            return self._pack(" " + part)
        if not part or part[0].isspace() or part[-1].isspace():
            return None
        if part[-1] in ",." and part[:-1].isalpha():
            one, two = self._pack(" " + part[:-1]), self._match[part[-1]]
            return one[0] + two[0], one[1] + two[1]
        return self._parts(" " + part)

    def _parts(self, text: str) -> tuple[bytes, bytes]:
        match = self._match
        return _joined([match[m] if len(m) <= CACHED_PART else self._pack(m) for m in self.split(text)])

    def coded(self, text: str) -> tuple[bytes, bytes]:
        """A text's ids as little-endian unsigned 32-bit integers, and the bytes that they decode to."""
        first, *rest = text.split(" ")
        if not rest:
            return self._parts(text)
        after = self._after
        if max(map(len, rest)) > CACHED_PART:
            made = [after[s] if len(s) <= CACHED_PART else after.make(s) for s in rest]
        else:
            made = list(map(after.__getitem__, rest))
        if None in made or not first or first[-1].isspace():
            return self._parts(text)
        return _joined([self._first[first], *made])

    def packed(self, text: str) -> bytes:
        return self.coded(text)[0]

    def encode(self, text: str) -> list[int]:
        return memoryview(self.packed(text)).cast("I").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes that token ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids))



def _joined(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    ids, plain = zip(*parts, strict=True) if parts else ((), ())
    return b"".join(ids), b"".join(plain)


class EncodedText:
    """A text's encoding that follows appends and edits exactly."""

    def __init__(self, bpe: ByteBpe, text: str = ""):
        self.bpe, self.text, self.matches = bpe, text, []
        self._tables: list[PrefixTable] = []
        self._replace(0, 0, bpe.split(text))

    def _replace(self, a: int, b: int, matches: list[str]) -> None:
        old = self._tables[a:b]
        new = []
        for m in matches:
            data, table = m.encode(), None
            if old and data.startswith(old[0].data):
                table = old.pop(0)
                table.append(data[len(table.data) :])
            new.append(table or PrefixTable(self.bpe, data))
        self._tables[a:b], self.matches[a:b] = new, matches

    def append(self, more: str) -> None:
        """The last match may grow or be cut anew; no other one changes."""
        tail = self.matches[-1] if self.matches else ""
        self.text += more
        self._replace(max(0, len(self.matches) - 1), len(self.matches), self.bpe.split(tail + more))

    def edit(self, start: int, end: int, new: str) -> int:
        """Puts new in place of text[start:end]; returns the number of matches done again."""
        first, at = 0, 0
        while first < len(self.matches) and at + len(self.matches[first]) < start:
            at += len(self.matches[first])
            first += 1
        if first:  # a match may have looked one character ahead
            first -= 1
            at -= len(self.matches[first])
        stop, edge = first, at
        while stop < len(self.matches) and edge < end:
            edge += len(self.matches[stop])
            stop += 1
        text = self.text[:start] + new + self.text[end:]
        shift = len(text) - len(self.text)
        while True:  # as far as a match ends where an old one ended; from there on the rest is as before
            ahead = len(self.matches[stop]) if stop < len(self.matches) else 0
            found = self.bpe.split(text[at : edge + shift + ahead])
            size, k = 0, 0
            while k < len(found) and size < edge + shift - at:
                size += len(found[k])
                k += 1
            if size == edge + shift - at and (stop == len(self.matches) or k < len(found) or not ahead):
                break
            stop, edge = stop + 1, edge + ahead
        self.text = text
        self._replace(first, stop, found[:k])
        return k

    def ids(self) -> list[int]:
        return [i for t in self._tables for i in t.ids()]


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(data: bytes, pattern: str) -> ByteBpe:
    """The encoder of a rank file's content; each worker builds it once."""
    key = hashlib.sha256(data).hexdigest() + pattern
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteBpe(read_ranks(data), pattern)
    return _ENCODERS[key]


def encode_column(
    df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str | None = "ids", digests: bool = True
) -> DataFrame:
    """df plus its texts' token ids (``ids``, array<int>; None: left out) and, with digests, ``n_tokens``,
    ``ids_sha256`` and ``decoded_sha256`` of the bytes decoded from the ids.  New names must be free in df.

    The rank file (its size is fixed by the vocabulary) is read on the driver and broadcast once.
    """
    with open(ranks_path, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())
    at = df.columns.index(text)
    extra = [(ids, "array<int>")] * bool(ids) + [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")] * digests
    clash = {n.lower() for n, _ in extra} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(held.value, pattern)
        names = None
        for b in batches:
            packed, plain = [], []
            for i in range(0, b.num_rows, SLICE):
                for t in b.column(at).slice(i, SLICE).to_pylist():
                    own, back = bpe.coded(t or "")
                    packed.append(own)
                    plain.append(hashlib.sha256(back).hexdigest() if digests else "")
            cols = []
            if ids:
                cols.append(pa.array([memoryview(p).cast("I").tolist() for p in packed], pa.list_(pa.int32())))
            if digests:
                cols.append(pa.array([len(p) // 4 for p in packed], pa.int64()))
                cols += [pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()), pa.array(plain, pa.string())]
            names = names or [*b.schema.names, *(n for n, _ in extra)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` {t}" for n, t in extra])
    return df.mapInArrow(run, schema)


def decode_column(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df plus the bytes its ids stand for; null ids give null."""
    with open(ranks_path, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {r: t for t, r in read_ranks(held.value).items()}
        for b in batches:
            texts = [None if x is None else b"".join(map(tokens.__getitem__, x)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=[*b.schema.names, out])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{out}` binary"])
    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every whole text of documents, encoded and decoded."""
    import public_tokenizers as tokenizers

    from strata.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_column(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, ids=None).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )
