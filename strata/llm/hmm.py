"""A hidden Markov language model: Baum-Welch counts from all partitions, exact scaled forward scores.

Words fall into CLASSES classes: the OWN most frequent ones each have their own, the others share one
by their last three bytes.  The model emits a class in each latent state, and a word within its
class by its training count plus one (an unseen word as if it were one more word of its class).

1. Counts of every training token, summed before they are shuffled (they grow with the input).
2. One pass writes each text's class sequence and the words outside the FREQUENT most frequent.
3. Baum-Welch: each pass adds expected counts over all training tokens, by the scaled forward and
   backward recursions over whole sequences, many side by side; a task sends STATES x CLASSES sums
   at most, and their total is fixed in size.
4. Whole sequences are scored by the scaled forward recursion; counts of infrequent words come by
   a join on the word, whose hot keys adaptive execution splits, and are summed by row.

What is sent to the driver and broadcast is bounded, whatever the input and its partitions: a
histogram of the counts finds the least count that at most FREQUENT words reach, and only those
words, of up to WORD_BYTES bytes each, and the model's sums are collected.

Defined results: null is the empty text, which has the end token alone; rows with a null id are
learnt from; repeated rows are counted and scored each; without training rows every token is
unseen (N = V = 0) and the model stays uniform.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, table

STATES, PASSES = 6, 6
#: Tokens whose forward probabilities a task holds at a time (a longer sequence is held alone), and tokens from which a
#: sequence waits for others of its kind.
HELD, LONG = 600_000, 4096
OWN, SHARED = 2048, 2048
CLASSES = OWN + SHARED
FREQUENT, WORD_BYTES = 131_072, 64
#: The end token's key; no word holds a line feed.
END = b"\n"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all texts of df, END among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])

        held: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(words_of(t))
                if len(held) > 300_000:
                    yield out(held)
                    held = Counter()
            held[END] += len(b)
        if held:
            yield out(held)

    return df.select(F.col(f"`{text}`")).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What a worker needs to know of the counts; fixed in size."""

    def __init__(self, frequent: list[tuple[bytes, int]], shared: dict[int, tuple[int, int]], tokens: int, distinct: int):
        """frequent: END, then the most frequent words; shared: class -> (tokens, distinct words) of the classes that words share."""
        self.words, self.tokens, self.distinct = [w for w, _ in frequent], tokens, distinct
        self.counts = np.array([c for _, c in frequent], np.int64)
        self.kinds = np.array([i if i < OWN else self.shared(w) for i, w in enumerate(self.words)], np.int16)
        size = np.zeros(SHARED)
        for k, (n, v) in shared.items():
            size[k - OWN] = n + v
        self.size = np.log10(size + 1)

    @staticmethod
    def shared(word: bytes) -> int:
        return OWN + zlib.crc32(word[-3:]) % SHARED

    def codes(self) -> _Codes:
        return _Codes(self.words)


class _Codes(dict):
    """word -> its place among the frequent ones, or -1 - its class."""

    def __init__(self, frequent):
        super().__init__((w, i) for i, w in enumerate(frequent))
        self.room = len(self) + 500_000
        self.rare: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            for w in self.rare:
                del self[w]
            self.rare.clear()
        value = self[word] = -1 - Vocabulary.shared(word)
        self.rare.append(word)
        return value


#: Steps of the histogram of counts by their binary logarithm.
STEPS = 64


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(word, c) of the most frequent words, by c and word: as many whole steps of the counts' histogram as hold at most ``most`` words."""
    own = counts.where((F.octet_length("word") <= WORD_BYTES) & (F.col("word") != F.lit(END)))
    own = own.withColumn("step", F.floor(F.log2("c") * STEPS))
    held, least = 0, None
    for step, n in sorted(own.groupBy("step").agg(F.count("*")).collect(), reverse=True):  # 64 * STEPS rows at most
        if held + n > most:
            break
        held, least = held + n, step
    if least is None:
        return []
    return sorted(((bytes(w), c) for w, c in own.where(F.col("step") >= least).select("word", "c").collect()), key=lambda x: (-x[1], x[0]))


def vocabulary(counts: DataFrame) -> Vocabulary:
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = frequent_words(counts, FREQUENT - 1)
    end = counts.where(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    kind = F.lit(OWN) + F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(SHARED))
    shared = {int(k): [n, v] for k, n, v in counts.groupBy(kind.alias("k")).agg(F.sum("c"), F.count("*")).collect()}
    for w, c in [(END, end)] * (end > 0) + top[: OWN - 1]:  # those with a class of their own are in no shared one
        shared[Vocabulary.shared(w)][0] -= c
        shared[Vocabulary.shared(w)][1] -= 1
    return Vocabulary([(END, end), *top], {k: (n, v) for k, (n, v) in shared.items()}, int(tokens), int(distinct))


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.start = np.full(STATES, 1 / STATES)
        self.step = np.full((STATES, STATES), 0.05 / (STATES - 1)) + np.eye(STATES) * (0.95 - 0.05 / (STATES - 1))
        self.emit = rng.uniform(0.5, 1.5, (CLASSES, STATES))
        self.emit /= self.emit.sum(0)

    def learn(self, sums: np.ndarray) -> None:
        """sums: expected starts, transitions and emissions, flat."""
        starts, rest = sums[:STATES], sums[STATES:]
        steps, emits = rest[: STATES**2].reshape(STATES, STATES), rest[STATES**2 :].reshape(CLASSES, STATES)
        self.start = (starts + 1) / (starts.sum() + STATES)
        self.step = (steps + 1) / (steps.sum(1, keepdims=True) + STATES)
        share = (emits.sum(1) + 1) / (emits.sum() + CLASSES)  # a class in no state keeps a share by its own count
        self.emit = emits + 50 * share[:, None]
        self.emit /= self.emit.sum(0)


SUMS = STATES + STATES**2 + CLASSES * STATES


def expected_counts(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Expected starts, transitions and emissions of whole sequences, coded side by side.

    Sequences are sorted by length, so step j concerns the first alive[j] of them; forward
    probabilities are held for the tokens that there are, step after step.
    """
    sums = np.zeros(SUMS)
    texts = sorted((t for t in texts if len(t)), key=len, reverse=True)
    if not texts:
        return sums
    sizes = np.array([len(t) for t in texts])
    flat, starts = np.concatenate(texts), np.cumsum(sizes) - sizes
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right").tolist()
    at = [0, *np.cumsum(alive).tolist()]
    seen = np.empty(at[-1], np.int64)
    for j, m in enumerate(alive):
        seen[at[j] : at[j + 1]] = flat[starts[:m] + j]
    likely = model.emit[seen]
    alpha, scale = np.empty((at[-1], STATES)), np.empty(at[-1])
    for j, m in enumerate(alive):
        a = likely[at[j] : at[j + 1]] * (model.start if j == 0 else alpha[at[j - 1] : at[j - 1] + m] @ model.step)
        norm = a.sum(1)
        scale[at[j] : at[j + 1]] = norm
        alpha[at[j] : at[j + 1]] = a / norm[:, None]
    likely /= scale[:, None]
    beta, steps = np.ones((len(texts), STATES)), np.zeros((STATES, STATES))
    for j in range(len(alive) - 1, 0, -1):
        m, own = alive[j], slice(at[j], at[j + 1])
        ahead = likely[own] * beta[:m]
        alpha[own] *= beta[:m]  # from here on the probabilities of step j's states; step j + 1 is done with it
        steps += alpha[at[j - 1] : at[j - 1] + m].T @ ahead
        beta[:m] = ahead @ model.step.T
    first = slice(0, len(texts))
    alpha[first] *= beta
    sums[:STATES] = alpha[first].sum(0)
    sums[STATES : STATES + STATES**2] = (steps * model.step).ravel()
    emits = np.empty((CLASSES, STATES))
    for k in range(STATES):
        emits[:, k] = np.bincount(seen, alpha[:, k], CLASSES)
    sums[STATES + STATES**2 :] = emits.ravel()
    return sums


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of each whole sequence's probability, by the scaled forward recursion."""
    out = np.zeros(len(texts))
    order = sorted((i for i, t in enumerate(texts) if len(t)), key=lambda i: -len(texts[i]))
    if not order:
        return out
    sizes = np.array([len(texts[i]) for i in order])
    flat, starts = np.concatenate([texts[i] for i in order]), np.cumsum(sizes) - sizes
    alpha, total = None, np.zeros(len(order))
    left = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right").tolist()
    for j, m in enumerate(left):
        alpha = np.tile(model.start, (m, 1)) if j == 0 else alpha[:m] @ model.step
        alpha *= model.emit[flat[starts[:m] + j]]
        norm = alpha.sum(1)
        alpha /= norm[:, None]
        total[:m] += np.log10(norm)
    out[order] = total
    return out


def _chunks(seqs: Iterable[np.ndarray], most: int) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for s in seqs:
        if n and n + len(s) > most:
            yield held
            held, n = [], 0
        held.append(s)
        n += len(s)
    if held:
        yield held


def _alike(batches: Iterable[list[np.ndarray]], most: int = HELD) -> Iterator[list[np.ndarray]]:
    """All sequences in chunks of about equal lengths; long ones of several batches together."""
    late: list[np.ndarray] = []
    for seqs in batches:
        late += [s for s in seqs if len(s) >= LONG]
        yield from _chunks(sorted((s for s in seqs if len(s) < LONG), key=len), most)
        if sum(map(len, late)) >= most:
            yield from _chunks(late, most)
            late = []
    yield from _chunks(late, most)


def read_texts(df: DataFrame, learn: Column, words: Vocabulary, doc_id: str, text: str) -> DataFrame:
    """Per row: its classes, sums over frequent words, and its infrequent words with their counts."""
    held = df.sparkSession.sparkContext.broadcast(words)
    names = ["rid", "doc_id", "learnt", "n_tokens", "n_known", "plain", "within", "seq", "rare", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        code_of = v.codes()
        logs, known = np.log10(v.counts + 1), (v.counts > 0).astype(np.int64)
        for b in batches:
            rows = []
            for t in b.column(3).to_pylist():
                own = words_of(t)
                own.append(END)
                code = np.fromiter(map(code_of.__getitem__, own), np.int64, len(own))
                common = code >= 0
                kind = np.where(common, v.kinds[np.maximum(code, 0)], -1 - code)
                log = np.where(common, logs[np.maximum(code, 0)], 0)
                shared = kind >= OWN
                within = log[shared].sum() - v.size[kind[shared] - OWN].sum()
                rare = Counter([own[i] for i in np.flatnonzero(~common).tolist()])
                rows.append((len(own), int(known[code[common]].sum()), float(log.sum()), float(within), kind.astype(np.int16).tobytes(), list(rare), list(rare.values())))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], names=names)

    kind = df.schema[doc_id].dataType.simpleString()
    source = df.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{doc_id}`").alias("doc_id"), learn.alias("learnt"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(
        run, f"rid bigint, doc_id {kind}, learnt boolean, n_tokens bigint, n_known bigint, plain double, within double, seq binary, rare array<binary>, times array<bigint>"
    )


def train(texts: DataFrame, passes: int = PASSES) -> Model:
    """Baum-Welch over the rows of texts that are learnt from."""
    model, sc = Model(), texts.sparkSession.sparkContext
    rows = texts.where("learnt").select("seq")
    for _ in range(passes):
        held = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(SUMS)
            for chunk in _alike([np.frombuffer(x, np.int16) for x in b.column(0).to_pylist()] for b in batches):
                sums += expected_counts(held.value, chunk)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["i", "v"])

        sums = np.zeros(SUMS)
        for i, v in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():  # SUMS rows at most
            sums[i] = v
        model.learn(sums)
    return model


def score(df: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", passes: int = PASSES) -> DataFrame:
    """(doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    counts = cut(token_counts(df.where(learn), text))
    words = vocabulary(counts)
    texts = cut(read_texts(df, learn, words, doc_id, text))
    model = train(texts, passes)
    held = df.sparkSession.sparkContext.broadcast(model)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs = [log_likelihoods(held.value, c) for c in _chunks([np.frombuffer(x, np.int16) for x in b.column(6).to_pylist()], 4_000_000)]
            cols = [b.column(i) for i in range(6)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(logs) if logs else np.zeros(0))], names=[*b.schema.names[:6], "classes"])

    kind = df.schema[doc_id].dataType.simpleString()
    scored = texts.select("rid", "doc_id", "learnt", "n_tokens", "n_known", F.struct("plain", "within").alias("sums"), "seq").mapInArrow(
        forward, f"rid bigint, doc_id {kind}, learnt boolean, n_tokens bigint, n_known bigint, sums struct<plain:double,within:double>, classes double"
    )
    rare = texts.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("n"))
    found = rare.join(counts, "word").groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"), F.sum("n").alias("more"))
    joined = scored.join(found, "rid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    size = float(np.log10(words.tokens + words.distinct + 1))
    return joined.select(
        "doc_id", "learnt", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("bigint").alias("train_tokens"),
        (F.col("sums.plain") + logs - F.col("n_tokens") * F.lit(size)).alias("base_score"),
        (F.col("classes") + F.col("sums.within") + logs).alias("score"),
    )


def query(spark, sf_dir):
    """op8: the whole of documents, learnt from the rows whose id's CRC-32 modulo 7 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    return score(docs, ~out).select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
