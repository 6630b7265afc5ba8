"""Near-duplicate groups from a MinHash LSH forest, confirmed on whole shingle sets.

Documents with equal shingle sets are one node.  TREES trees sort all nodes, each by its own
sequence of DEEPEST minima; the longer the common prefix of two neighbours in such an order, the
likelier they are alike.  Nodes with a common prefix of DEPTH minima form a region, whose nodes are
all candidates of each other.  A region of up to ROWS nodes and SHINGLES shingles is compared whole
in one task, on whole sets; regions with the same nodes in several trees are compared once.

The depth of a larger region adapts: it is divided by longer prefixes until its parts fit, so the
longest-common-prefix neighbours meet first.  What even the longest prefix leaves too large is
dealt by hash, and the best-linked node of all its parts meets every part.  Division alone would
lose links between parts, so a second round makes up for it, exactly: every node outside a large
region's largest component meets every node of the region, in blocks of parts against parts.  Nodes
with too many shingles of their own to reach the similarity (an exact bound) are left out of it.

No partner or candidate is capped.  Tasks return a spanning forest of the links they find, at most
one link for each of their rows, never the pairs of a group; sets go to a task once for each row of
a block, not for each pair.  Rows that a large region leaves outside its largest component cost
blocks with the product of both counts.

Two sets with similarity 0.8 meet in a region of some tree with probability
1 - (1 - 0.8**3)**16 = 0.99999, whatever the region's size and depth; all later steps are exact.

Defined results: null or blank texts have no shingles and stand alone; a text of fewer words than
a shingle is one shingle; ``component_id`` is the smallest id of the component, null if none has
one; rows without an id are kept only if their whole component has none; extra columns are left
out of ``near_duplicates`` and pass through ``keep_one``, whatever their names; rows equal in id
and text get equal results, and ``keep_one`` leaves one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, flagged, fresh, table

#: Trees, minima of a region's prefix, and minima of a tree's whole key (two bytes each).
TREES, DEPTH, DEEPEST = 16, 3, 6
#: Nodes and shingles that one task compares at a time.
ROWS, SHINGLES = 1024, 1 << 19
#: Texts that a worker holds as sets at a time.
SLICE = 64

_rng = np.random.default_rng(7)
_A = (_rng.integers(1, 1 << 63, TREES * DEEPEST, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, TREES * DEEPEST, dtype=np.uint64)
_P = (_rng.integers(1, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


class _Words(dict):
    """word (UTF-8) -> 64-bit hash; starts again when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(w) < width:
        return _mixed(_mixed((w * _P[: len(w)]).sum(dtype=np.uint64, keepdims=True)) + np.uint64(len(w)))
    n = len(w) - width + 1
    x = np.zeros(n, np.uint64)
    for i in range(width):
        x += _mixed(w[i : i + n] + _P[i]) if i else w[:n] * _P[0]
        x *= _P[32 + i]
    return np.unique(_mixed(x))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """len(sets) x (TREES * DEEPEST) minima, two bytes of each; none of the sets empty."""
    x, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), TREES * DEEPEST), np.uint16)
    for k in range(TREES * DEEPEST):
        out[:, k] = np.minimum.reduceat(((x * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), starts).astype(np.uint16)
    return out


def _row_key(doc_id: str, text: str) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.col(f"`{text}`"))))


def sketches(df: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, n_shingles, digest, minima): digest names the set, row the document; digest null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, minima = [], [], []
            for i in range(0, b.num_rows, SLICE):
                sets = [shingle_set(t, width) for t in b.column(2).slice(i, SLICE).to_pylist()]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full).astype(">u2") if full else ())
                for s in sets:
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    minima.append(next(sig).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(minima, pa.binary())],
                names=["doc_id", "row", "n_shingles", "digest", "minima"],
            )

    kind = df.schema[doc_id].dataType.simpleString()
    held = df.select(F.col(f"`{doc_id}`").alias("doc_id"), _row_key(doc_id, text).alias("row"), F.col(f"`{text}`"))
    return held.mapInArrow(run, f"doc_id {kind}, row binary, n_shingles bigint, digest binary, minima binary")


def _prefix(depth: int) -> Column:
    return F.substring("key", 1, 2 * depth)


def _parts(n: str, weight: str) -> Column:
    """Into how many parts n nodes with so many shingles are dealt."""
    return F.greatest(F.ceil(F.col(n) / ROWS), F.ceil(F.col(weight) / SHINGLES)).cast("int")


def _counted(rows: DataFrame) -> DataFrame:
    """rows with their block's nodes (n) and shingles (weight), of blocks of several nodes."""
    sizes = rows.groupBy("block").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1")
    return rows.drop("n", "weight").join(sizes, "block")


def forest_regions(nodes: DataFrame) -> DataFrame:
    """(block, key, digest, size, n, weight): the nodes of every region of several nodes, which block names."""
    tree, step = F.col("tree"), 2 * DEEPEST
    rows = nodes.select("digest", "size", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "minima")
    rows = rows.select("digest", "size", F.col("minima").substr(tree * step + 1, F.lit(step)).alias("key"), "tree")
    rows = rows.select(F.xxhash64("tree", _prefix(DEPTH)).alias("block"), "key", "digest", "size")
    several = cut(rows.groupBy("block").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1"))
    found = flagged(rows, several, ["block"], "several").where("several").drop("several")  # most nodes are in no region
    members = cut(found.join(several, "block"))
    # The same nodes may form a region in several trees; two sums of hashes tell.
    same = members.groupBy("block").agg(
        F.first("n").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "digest")).alias("y")
    )
    once = same.groupBy("n", "x", "y").agg(F.min("block").alias("block")).select("block")
    return cut(members.join(once, "block", "left_semi"))


def _blocks(regions: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Blocks that fit a task: whole regions, parts of large ones by their longest prefixes; and what hash parts they had."""
    fits = (F.col("n") <= ROWS) & (F.col("weight") <= SHINGLES)
    blocks, left, depth = [regions.where(fits)], large, DEPTH
    while depth < DEEPEST and not left.isEmpty():
        depth += 1
        parts = cut(_counted(left.withColumn("block", F.xxhash64("block", _prefix(depth)))))
        blocks.append(parts.where(fits))
        left = parts.where(~fits)
    names = ["block", "digest"]
    whole = blocks[0].select(*names)
    for b in blocks[1:]:
        whole = whole.unionByName(b.select(*names))
    if left.isEmpty():
        return whole, None
    part = F.pmod(F.xxhash64("digest"), _parts("n", "weight"))
    dealt = cut(left.select(F.col("block").alias("region"), F.xxhash64("block", part).alias("block"), "digest"))
    return whole.unionByName(dealt.select(*names)), dealt


def linked(sets: list[np.ndarray], role: np.ndarray, comp: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Links i - each of the rows taken, a spanning forest of all links of sets that are not of one component yet.

    Rows go through a group from those with the most common shingles on; each takes those that it is
    linked with and that no other row of its group has taken.  If there are rows of role 1, they
    are compared with rows of role 0 alone.
    """
    size = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.r_[0, np.cumsum(size)[:-1]]
    _, ids, count = np.unique(flat, return_inverse=True, return_counts=True)
    count = count[ids]
    common = np.add.reduceat((count > 1).astype(np.int64), starts)
    free = 100 * common >= percent * size  # others share too little with anyone here
    if free.sum() < 2:
        return
    score, both_roles = np.add.reduceat(count, starts) / size, bool(role.any())
    of = {}
    for i, c in enumerate(comp):
        of.setdefault(c, []).append(i)
    mark = np.zeros(int(ids.max()) + 1, bool)
    rows = np.flatnonzero(free)  # those still in flat
    own = [ids[a : a + n] for a, n in zip(starts, size, strict=True)]
    flat, starts = np.concatenate([own[i] for i in rows]), np.r_[0, np.cumsum(size[rows])[:-1]]

    def taken(i: int) -> np.ndarray:
        mark[own[i]] = True
        both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[own[i]] = False
        hit = free[rows] & (100 * both >= percent * (size[rows] + size[i] - both))
        return rows[hit & (role[rows] != role[i])] if both_roles else rows[hit]

    for first in np.argsort(-score, kind="stable"):
        if not free[first]:
            continue
        queue = of[comp[first]][:]
        free[queue] = False
        while queue:
            live = free[rows]
            if not live.any():
                break
            if 2 * live.sum() < len(rows):
                rows = rows[live]
                flat, starts = np.concatenate([own[i] for i in rows]), np.r_[0, np.cumsum(size[rows])[:-1]]
            i = queue.pop()
            hit = taken(i)
            if len(hit):
                yield i, hit
                for j in hit:
                    if free[j]:
                        free[of[comp[j]]] = False
                        queue += of[comp[j]]


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks, of batches sorted by block."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        block = b.column(0).to_numpy()
        if held and len(block) and held[-1].column(0)[-1].as_py() == block[0]:
            end = int(np.searchsorted(block, block[0], "right"))
            held.append(b.slice(0, end))
            b, block = b.slice(end), block[end:]
        if len(block):
            if held:
                yield pa.Table.from_batches(held)
            last = int(np.searchsorted(block, block[-1]))
            if last:
                yield pa.Table.from_batches([b.slice(0, last)])
            held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def links_within(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(block, a, b): spanning links within the blocks of rows (block, digest, role, comp), found on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_blocks(batches):
            block, out = t["block"].to_numpy(), ([], [], [])
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for start, end in zip(edges, edges[1:], strict=False):
                if end - start < 2:
                    continue
                digest, role, comp, held = (t[c].slice(start, end - start).to_pylist() for c in ("digest", "role", "comp", "set"))
                for i, hit in linked([np.frombuffer(s, np.uint64) for s in held], np.array(role), comp, percent):
                    out[0].extend([block[start]] * len(hit))
                    out[1].extend([digest[i]] * len(hit))
                    out[2].extend([digest[j] for j in hit])
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "a", "b"])

    held = rows.join(sets, "digest").select("block", "digest", "role", "comp", "set")
    return held.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block bigint, a binary, b binary")


def sets_of(df: DataFrame, rows: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(digest, set) of rows (digest, row): the shingle sets of the documents that row names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                few = b.slice(i, SLICE)
                sets = [shingle_set(t, width).tobytes() for t in few.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(sets, pa.binary())], names=["digest", "set"])

    held = df.select(_row_key(doc_id, text).alias("row"), F.col(f"`{text}`").alias("text"))
    texts = flagged(held, rows, ["row"], "wanted").where("wanted").groupBy("row").agg(F.min("text").alias("text"))
    return cut(texts.join(rows, "row").select("digest", "text").mapInArrow(run, "digest binary, set binary"))


def unique_shingles(sets: DataFrame) -> DataFrame:
    """(node, own): how many of a node's shingles no other node in sets has; node is the digest's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column(0).to_numpy()
            for i in range(0, b.num_rows, SLICE):
                held = b.column(1).slice(i, SLICE).to_pylist()
                x = np.frombuffer(b"".join(held), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.repeat(node[i : i + SLICE], [len(s) // 8 for s in held]))], names=["x", "node"])

    spread = sets.select(F.xxhash64("digest").alias("node"), "set").mapInArrow(run, "x bigint, node bigint")
    once = spread.groupBy("x").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    return once.groupBy("node").agg(F.count("*").alias("own"))


def components(links: DataFrame) -> DataFrame:
    """(digest, comp) of every node in links (a, b): comp is the smallest node reachable.

    Smallest labels spread along links, then every label takes its own label's label, so the
    rounds grow with the logarithm of a component's width.  Joins are plain ones on keys, which
    adaptive execution splits where a node or label is hot.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("digest")).agg(F.min("b").alias("m")).select("digest", F.least("digest", "m").alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("digest", "b"), "b").groupBy(F.col("a").alias("digest")).agg(F.min("comp").alias("m"))
        spread = cut(labels.join(near, "digest").select("digest", F.least("comp", "m").alias("comp"), F.col("comp").alias("was")))
        jump = spread.select(F.col("digest").alias("comp"), F.col("comp").alias("next"))
        new = cut(spread.join(jump, "comp").select("digest", F.least("comp", "next").alias("comp"), "was"))
        if new.where(F.col("comp") != F.col("was")).isEmpty():
            return new.select("digest", "comp")
        labels = new.select("digest", "comp")


def _plain(rows: DataFrame, role: int = 0) -> DataFrame:
    return rows.select("block", "digest", F.lit(role).alias("role"), F.col("digest").alias("comp"))


def _first_links(regions: DataFrame, large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    blocks, dealt = _blocks(regions, large)
    links = cut(links_within(_plain(blocks), sets, percent))
    if dealt is None:
        return links
    parts = dealt.select("region", "block").distinct()
    best = links.join(parts, "block").groupBy("region", "a").agg(F.count("*").alias("n"))
    best = best.groupBy("region").agg(F.max(F.struct("n", "a")).alias("top")).select("region", F.col("top.a").alias("digest"))
    probes = _plain(parts.join(best, "region"), 1)
    return links.unionByName(cut(links_within(probes.unionByName(_plain(dealt)), sets, percent)))


def _second_links(large: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links in large regions between nodes outside the largest component and all nodes; None if there are no such nodes."""
    rows = large.select("block", "digest", "size").join(labels, "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    if rows.groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").isEmpty():
        return None
    own = cut(unique_shingles(sets.join(large.select("digest").distinct(), "digest", "left_semi")))
    rows = rows.withColumn("node", F.xxhash64("digest")).join(own, "node", "left")
    rows = cut(rows.where(100 * (F.col("size") - F.coalesce("own", F.lit(0))) >= percent * F.col("size")).drop("node", "own"))
    sizes = rows.groupBy("block", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("w")).groupBy("block")
    sizes = sizes.agg(F.max(F.struct("n", "w", "comp")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    sizes = sizes.withColumn("n2", F.col("n") - F.col("top.n")).withColumn("w2", F.col("w") - F.col("top.w")).where("n2 > 0")
    rows = rows.join(sizes.select("block", F.col("top.comp").alias("main"), _parts("n", "w").alias("all"), _parts("n2", "w2").alias("rest")), "block")

    def part(of: str) -> Column:
        return F.pmod(F.xxhash64("digest"), F.col(of))

    def each(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    held = rows.withColumn("a", part("all")).withColumn("b", each("rest")).withColumn("role", F.lit(0))
    probes = rows.where(F.col("comp") != F.col("main")).withColumn("b", part("rest")).withColumn("a", each("all")).withColumn("role", F.lit(1))
    names = ["block", "digest", "role", "comp"]
    both = held.unionByName(probes, allowMissingColumns=True).withColumn("block", F.xxhash64("block", F.col("a").cast("int"), F.col("b").cast("int")))
    return cut(links_within(both.select(*names), sets, percent))


def grouped(df: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, row, comp) for every row of df: rows of equal comp are one group, row names (id, text)."""
    held = cut(sketches(df, width, doc_id, text))
    full = held.where(F.col("digest").isNotNull())
    nodes = cut(full.groupBy("digest").agg(F.min("row").alias("row"), F.min("minima").alias("minima"), F.min("n_shingles").alias("size")))
    regions = forest_regions(nodes)
    large = regions.where((F.col("n") > ROWS) | (F.col("weight") > SHINGLES))
    wanted = cut(nodes.select("digest", "row").join(regions.select("digest").distinct(), "digest", "left_semi"))
    sets = sets_of(df, wanted, width, doc_id, text)
    links = _first_links(regions, large, sets, percent)
    labels = components(links)
    more = None if large.isEmpty() else _second_links(large, labels, sets, percent)
    if more is not None and not more.isEmpty():
        labels = components(links.unionByName(more))
    named = held.select("doc_id", "n_shingles", "row", "digest").join(labels, "digest", "left")
    return cut(named.select("doc_id", "n_shingles", "row", F.coalesce("comp", "digest", "row").alias("comp")))


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of df."""
    named = grouped(df, width, percent, doc_id, text)
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return named.join(least, "comp", "left").select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(df: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group: the one with the smallest id (rows without an id last).

    Only rows that may have to go are shuffled.
    """
    named = grouped(df, width, percent, doc_id, text)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    stays = named.groupBy("comp").agg(first.alias("f")).select("comp", F.col("f.row").alias("stays"))
    rows = named.groupBy("row").agg(F.min("comp").alias("comp"), F.count("*").alias("n")).join(stays, "comp")
    key, gone, maybe = fresh(df, "__row"), fresh(df, "__gone"), fresh(df, "__maybe")
    doubtful = cut(rows.where((F.col("row") != F.col("stays")) | (F.col("n") > 1)).select(F.col("row").alias(key), (F.col("row") != F.col("stays")).alias(gone)))
    seen = flagged(df.withColumn(key, _row_key(doc_id, text)), doubtful, [key], maybe)
    once = seen.where(F.col(maybe)).dropDuplicates([key]).join(doubtful, key, "left").where(~F.coalesce(F.col(gone), F.lit(False)))
    return seen.where(~F.col(maybe)).select(*_quoted(df)).unionByName(once.select(*_quoted(df)))


def _quoted(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def query(spark, sf_dir):
    """op4: four-word shingles of the whole of documents."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)
