"""Quality scores: random-indexing word vectors, pooled per document, and a small calibrated network.

Every word has two tokens, itself and its shape (letters, digits and signs with runs collapsed).  Each
token has a random ternary index vector of its own, seeded by its hash.  A word's context vector is
the sum, over all words of all texts, of the index vectors of the words around it; context vectors
are kept in a fixed number of slots, which rare words share by hash.  The sums are integers, so they
do not depend on how rows are dealt out.  A document's features are the mean and spread of its words' vectors.
A two-layer network is fitted to the labels on a sample of bounded size, and a temperature, fitted
on rows kept from it, calibrates its probabilities.

Scale: two passes over the texts without a shuffle of them; the first one's partial sums are one
row per slot and task at most, added up by Spark.  What reaches the driver is fixed in size: the
slot table (SLOTS x DIMS integers) and the labelled sample (``max_train`` rows).

Defined results: null and empty texts have zero features and get the score the network gives those;
labels with a null side are left out; repeated rows are scored alike; without labels, or with one
class only, every score is the smoothed share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, table

WORD_SLOTS, SHAPE_SLOTS, DIMS, WINDOW = 32_768, 2048, 24, 2
SLOTS = WORD_SLOTS + SHAPE_SLOTS
#: Labelled rows that the network is fitted to, at most; chosen by a hash of their id.
MAX_TRAIN = 20_000
#: Words done at a time; texts are never divided.
CHUNK = 200_000

_RUNS = re.compile(rb"(.)\1+", re.S)
_CLASSES = bytes(ord("a") if 97 <= i <= 122 else ord("A") if 65 <= i <= 90 else ord("0") if 48 <= i <= 57 else i if i < 128 else ord("u") for i in range(256))


class _Words(dict):
    """word (UTF-8) -> its place in ``hashes``, the hashes of words and of their shapes."""

    def __init__(self):
        super().__init__()
        self.hashes = (array("Q"), array("Q"))

    def __missing__(self, word: bytes) -> int:
        shape = _RUNS.sub(rb"\1+", word.translate(_CLASSES))
        for held, token in zip(self.hashes, (b"w" + word, b"s" + shape), strict=True):
            held.append(int.from_bytes(hashlib.blake2b(token, digest_size=8).digest(), "little"))
        self[word] = place = len(self)
        return place

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of words and of their shapes; starts again first when many words are held."""
        if len(self) > 300_000:
            self.clear()
            self.hashes = (array("Q"), array("Q"))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return tuple(np.frombuffer(h, np.uint64)[at] if words else np.zeros(0, np.uint64) for h in self.hashes)


_WORDS = _Words()
#: What a byte of a hash says of four dimensions: two bits each, -1 or 1 if they differ, else 0.
_TRITS = np.array([[(b >> 2 * k & 1) - (b >> 2 * k + 1 & 1) for k in range(4)] for b in range(256)], np.int8)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """The random ternary vectors that hashes seed."""
    return _TRITS[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : DIMS // 4]].reshape(-1, DIMS)


def slots(words: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (words % np.uint64(WORD_SLOTS)).astype(np.int64), (shapes % np.uint64(SHAPE_SLOTS)).astype(np.int64) + WORD_SLOTS


def _chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes of words, hashes of shapes, words per text) of runs of whole texts."""
    words: list[bytes] = []
    counts: list[int] = []
    for t in texts:
        own = t.encode().split() if t else []
        words += own
        counts.append(len(own))
        if len(words) >= CHUNK:
            yield *_WORDS.of(words), np.array(counts, np.int64)
            words, counts = [], []
    if counts:
        yield *_WORDS.of(words), np.array(counts, np.int64)


def context_sums(df: DataFrame, text: str = "text") -> DataFrame:
    """(slot, c0 ... c23): each slot's summed context over the whole of df; at most SLOTS rows."""
    names = [f"c{i}" for i in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((SLOTS, DIMS)), np.zeros(SLOTS, bool)
        for b in batches:
            for word, shape, counts in _chunks(b.column(0).to_pylist()):
                if not len(word):
                    continue
                place, doc = index_vectors(word) + index_vectors(shape), np.repeat(np.arange(len(counts)), counts)
                near = np.zeros((len(word), DIMS), np.int16)
                for d in range(1, WINDOW + 1):
                    same = (doc[d:] == doc[:-d])[:, None]
                    near[d:] += place[:-d] * same
                    near[:-d] += place[d:] * same
                for slot in slots(word, shape):
                    seen[slot] = True
                    for k in range(DIMS):
                        sums[:, k] += np.bincount(slot, near[:, k], SLOTS)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), *[pa.array(sums[held, k].astype(np.int64)) for k in range(DIMS)]], names=["slot", *names]
        )

    part = df.select(F.col(f"`{text}`")).mapInArrow(run, "slot int, " + ", ".join(f"{n} bigint" for n in names))
    return part.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names])


def word_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """SLOTS x DIMS unit vectors; its size is fixed."""
    out = np.zeros((SLOTS, DIMS), np.float32)
    for r in context_sums(df, text).collect():
        out[r[0]] = r[1:]
    out = np.sign(out) * np.sqrt(np.abs(out))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


N_FEATURES = 4 * DIMS + 1


def pool(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """One row of N_FEATURES for each text: mean and spread of its words' and shapes' vectors, and log length."""
    rows = []
    for word, shape, counts in _chunks(texts):
        out = np.zeros((len(counts), N_FEATURES), np.float32)
        full = np.flatnonzero(counts)
        if len(full):
            starts, n = (np.cumsum(counts) - counts)[full], counts[full][:, None]
            for i, slot in enumerate(slots(word, shape)):
                v = vectors[slot]
                mean = np.add.reduceat(v, starts, axis=0) / n
                out[full, 2 * i * DIMS : (2 * i + 1) * DIMS] = mean
                out[full, (2 * i + 1) * DIMS : (2 * i + 2) * DIMS] = np.sqrt(np.maximum(np.add.reduceat(v * v, starts, axis=0) / n - mean * mean, 0))
        out[:, -1] = np.log1p(counts) / 10
        rows.append(out)
    return np.concatenate(rows) if rows else np.zeros((0, N_FEATURES), np.float32)


class Network:
    """Two layers: standardised features, ``hidden`` rectified units, a logit over a temperature."""

    def __init__(self, hidden: int = 32, epochs: int = 60, rate: float = 0.01, batch: int = 256, seed: int = 1):
        self.hidden, self.epochs, self.rate, self.batch, self.seed = hidden, epochs, rate, batch, seed
        self.temperature, self.constant = 1.0, 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        a = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return a @ self.w2 + self.b2

    def fit(self, x: np.ndarray, y: np.ndarray, kept: np.ndarray) -> Network:
        """kept: rows that calibrate and fit nothing else."""
        if len(y):
            self.constant = (y.sum() + 1) / (len(y) + 2)
        if len(set(y.tolist())) < 2 or len(set(y[~kept].tolist())) < 2:
            return self
        rng, fit, goal = np.random.default_rng(self.seed), x[~kept].astype(np.float64), y[~kept].astype(np.float64)
        self.mean, self.scale = fit.mean(0), fit.std(0) + 1e-3
        z = (fit - self.mean) / self.scale
        p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, 0.1, self.hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(self.epochs):
            order = rng.permutation(len(z))
            for i in range(0, len(z), self.batch):
                k, t = order[i : i + self.batch], t + 1
                a = np.maximum(z[k] @ p[0] + p[1], 0)
                d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -40, 40))) - goal[k]) / len(k)
                back = d[:, None] * p[2] * (a > 0)
                for j, g in enumerate((z[k].T @ back + 1e-4 * p[0], back.sum(0), a.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                    m[j] += 0.1 * (g - m[j])
                    v[j] += 0.001 * (g * g - v[j])
                    p[j] -= self.rate * (1 - epoch / self.epochs) * m[j] / (1 - 0.9**t) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = p
        if kept.any():
            far, truth = self.logits(x[kept].astype(np.float64)), y[kept]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
            loss = [np.mean(np.logaddexp(0, -np.where(truth == 1, far, -far) / g)) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not hasattr(self, "w1"):
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def _fold(doc_id: Column, n: int, salt: str = "") -> Column:
    return F.pmod(F.crc32(F.concat(doc_id.cast("string"), F.lit(salt)).cast("binary")), F.lit(n))


def classify(df: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", max_train: int = MAX_TRAIN) -> DataFrame:
    """df's id and ``score``: label 1's probability, learnt from the labels of rows for which learn holds.

    labels has doc_id and quality (0 or 1).  learn is a condition on ``doc_id``.
    """
    vectors = word_vectors(df, text)
    held = df.sparkSession.sparkContext.broadcast(vectors)  # SLOTS x DIMS, whatever the input

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pool(b.column(1).to_pylist(), held.value)
            rows = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), rows], names=["doc_id", "features"])

    kind = df.schema[doc_id].dataType.simpleString()
    pooled = cut(df.select(doc_id, F.col(f"`{text}`")).mapInArrow(features, f"doc_id {kind}, features binary"))
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    hashed = marked.where(learn).withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    # Hash order makes the sample the same whatever the partitions.  A hash bound leaves about 1.2 * max_train of the labels
    # before any is ordered, so tasks and driver get no more than that, however many partitions there are.
    n = hashed.count()
    if n > 1.2 * max_train + 1000:
        hashed = hashed.where(F.col("h") < int((1.2 * max_train + 1000) / n * 2**64) - 2**63)
    sample = (
        pooled.join(hashed, "doc_id")
        .select("h", "features", "quality", (_fold(F.col("doc_id"), 5, "kept") == 0).alias("kept"))
        .orderBy("h", "features", "quality")
        .limit(max_train)
        .collect()
    )
    x = np.frombuffer(b"".join(bytes(r.features) for r in sample), np.float32).reshape(-1, N_FEATURES)
    net = Network().fit(x, np.array([int(r.quality) for r in sample]), np.array([r.kept for r in sample], bool))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.scores(x), pa.float64())], names=["doc_id", "score"])

    return pooled.mapInArrow(score, f"doc_id {kind}, score double")


def query(spark, sf_dir):
    """op2: every text of documents, learnt from labels outside the held-out third."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.coalesce(_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    scored = classify(docs.select("doc_id", "text"), labels, ~out)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
