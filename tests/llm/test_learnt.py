import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from strata.llm import hmm, quality_classifier


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_classifier_separates_held_out_rows(spark):
    rng = random.Random(1)
    good, bad = ["the", "cat", "sat", "on", "mat", "and", "dog"], ["BUY!!", "WIN!!", "$$$", "NOW!!", "###"]
    docs = [(i, prose(rng, good if i % 3 else bad, rng.randint(1, 60)), "en") for i in range(600)]
    df = spark.createDataFrame([*docs, (10_000, None, "en"), (10_001, "", "en"), (None, "the cat", "en"), (1, docs[1][1], "en")], "doc_id bigint, text string, SCORE string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    out = F.pmod("doc_id", F.lit(4)) == 1
    got = quality_classifier.classify(df, labels, ~out).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 4 == 1]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 > 0) for r in held]) > 0.95
    again = {r.doc_id: r.score for r in quality_classifier.classify(df.repartition(5), labels, ~out).collect()}
    assert all(math.isclose(again[r.doc_id], r.score, abs_tol=1e-6) for r in got)
    assert {r.score for r in quality_classifier.classify(df, labels.limit(0), ~out).collect()} == {0.5}
    assert quality_classifier.classify(df.limit(0), labels, ~out).count() == 0


def test_vectors_and_features_against_brute_force(spark):
    """Context sums and pooled features, word by word in plain Python; labelled rows sampled by a hash bound."""
    qc = quality_classifier
    texts = ["the cat sat on the mat", "a b", "", None, "BUY now!! the cat", "x " * 30_000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, Slot int")
    sums = {}

    def hashes(w):
        return [int(h[0]) for h in qc._WORDS.of([w.encode()])]

    def slots(w):
        a, b = hashes(w)
        return a % qc.WORD_SLOTS, b % qc.SHAPE_SLOTS

    def index(h):
        return np.array([(h >> 2 * k & 1) - (h >> 2 * k + 1 & 1) for k in range(qc.DIMS)])

    assert hashes("cat") != hashes("dog") and hashes("cat")[1] == hashes("dog")[1] and len({tuple(index(hashes(f"w{i}")[0])) for i in range(500)}) == 500
    for t in texts:
        w = [slots(x) for x in (t or "").split()]
        place = [sum(map(index, hashes(x))) for x in (t or "").split()]
        for i, (a, b) in enumerate(w):
            near = sum((place[j] for j in range(max(0, i - qc.WINDOW), min(len(w), i + qc.WINDOW + 1)) if j != i), np.zeros(qc.DIMS, int))
            for s in (a, qc.WORD_SLOTS + b):
                sums[s] = sums.get(s, 0) + near
    got = {r.slot: np.array(r[1:]) for r in qc.context_sums(df).collect()}
    assert got.keys() == sums.keys() and all((got[s] == sums[s]).all() for s in sums)
    vectors = qc.word_vectors(df)
    for t, f in zip(texts, qc.pool(texts, vectors), strict=True):
        w = [slots(x) for x in (t or "").split()]
        parts = []
        for v in ([vectors[a] for a, _ in w], [vectors[qc.WORD_SLOTS + b] for _, b in w]):
            parts += [np.mean(v, 0), np.std(v, 0)] if w else [np.zeros(qc.DIMS)] * 2
        assert np.allclose(f, np.concatenate([*parts, [np.log1p(len(w)) / 10]]), atol=1e-3)
    net = qc.Network()
    net.mean, net.scale, net.w1, net.b1, net.w2, net.b2, net.temperature = np.zeros(2), np.ones(2), np.eye(2), np.zeros(2), np.ones(2), np.zeros(1), 2.0
    assert np.allclose(net.scores(np.array([[1.0, -5.0], [2.0, 2.0]])), 1 / (1 + np.exp([-0.5, -2.0])))
    many = spark.range(4000).selectExpr("id AS doc_id", "concat_ws(' ', 'the', concat('w', id % 7), 'end', concat('k', id % 7), 'of') AS text")
    labels = many.selectExpr("doc_id", "CAST(doc_id % 7 > 2 AS INT) AS quality")
    assert qc.classify(many, labels, F.lit(True), max_train=300).where("(score >= 0.5) <> (doc_id % 7 > 2)").count() < 200


def test_forward_and_counts_against_enumeration():
    model = hmm.Model()
    model.start = np.array([0.4, 0.2, 0.1, 0.1, 0.1, 0.1])
    seq = [3, 5, 3]
    total = 0.0
    for a in range(hmm.STATES):
        for b in range(hmm.STATES):
            for c in range(hmm.STATES):
                total += model.start[a] * model.emit[3, a] * model.step[a, b] * model.emit[5, b] * model.step[b, c] * model.emit[3, c]
    texts = [np.array(seq, np.int16), np.array([], np.int16), np.array([5] * 200, np.int16)]
    got = hmm.log_likelihoods(model, texts)
    assert math.isclose(got[0], math.log10(total), rel_tol=1e-9) and got[1] == 0 and got[2] < got[0]
    sums = hmm.expected_counts(model, texts)
    s = hmm.STATES
    assert math.isclose(sums[:s].sum(), 2) and math.isclose(sums[s : s + s * s].sum(), 2 + 199)  # every transition of whole sequences
    emits = sums[s + s * s :].reshape(hmm.CLASSES, s).sum(1)
    assert math.isclose(emits[3], 2) and math.isclose(emits[5], 201)
    # Whole sequences: the states' probabilities by enumeration of all paths.
    want = np.zeros(hmm.SUMS)
    for path in itertools.product(range(s), repeat=len(seq)):
        p = model.start[path[0]] * np.prod([model.emit[x, a] for x, a in zip(seq, path, strict=True)]) * np.prod([model.step[a, b] for a, b in itertools.pairwise(path)])
        p /= total
        want[path[0]] += p
        for a, b in itertools.pairwise(path):
            want[s + a * s + b] += p
        for x, a in zip(seq, path, strict=True):
            want[s + s * s + x * s + a] += p
    assert np.allclose(hmm.expected_counts(model, texts[:1]), want)
    rng = np.random.default_rng(3)
    many = [rng.integers(0, hmm.CLASSES, n).astype(np.int16) for n in (1, 7, 7, 300, 5000, 20_000, 0)]
    each = sum(hmm.expected_counts(model, [t]) for t in many)
    assert np.allclose(sum(hmm.expected_counts(model, c) for c in hmm._alike([many[:3], many[3:]], 400)), each)
    assert sorted(len(t) for c in hmm._alike([many], 400) for t in c) == sorted(map(len, many))


def test_frequent_words_by_whole_steps(spark):
    counts = spark.createDataFrame([(b"w%d" % i, 1 + 1000 // (i + 1)) for i in range(500)] + [(b"\n", 10_000), (b"x" * 100, 5000)], "word binary, c bigint")
    all_words = sorted(((f"w{i}".encode(), 1 + 1000 // (i + 1)) for i in range(500)), key=lambda x: (-x[1], x[0]))
    for most in (0, 1, 10, 100, 500):
        got = hmm.frequent_words(counts, most)
        assert len(got) <= most and got == all_words[: len(got)] and (most < 10 or len(got) > most // 3)


def test_whole_score_against_brute_force(spark):
    """The model's final scores, recomputed from its parts in plain Python; a text of 30,000 words is one sequence."""
    rng = random.Random(7)
    docs = [(i, prose(rng, ["a", "bb", "ccc", "dd", "e"], 20)) for i in range(40)] + [(90, " ".join(f"w{i % 9000}" for i in range(30_000))), (91, "new words xyz")]
    df = spark.createDataFrame([(i, t, 1.5) for i, t in docs], "doc_id bigint, text string, Score double")
    learn = F.col("doc_id") != 91
    got = {r.doc_id: r.score for r in hmm.score(df, learn, passes=2).collect()}
    words = hmm.vocabulary(hmm.token_counts(df.where(learn)))
    model = hmm.train(hmm.read_texts(df, learn, words, "doc_id", "text"), 2)
    counts = {}
    for i, t in docs:
        for w in hmm.words_of(t) + [hmm.END] if i != 91 else []:
            counts[w] = counts.get(w, 0) + 1
    kind = {w: int(k) for w, k in zip(words.words, words.kinds, strict=True)}
    size = {}
    for w, c in counts.items():
        n = size.setdefault(kind.get(w, hmm.Vocabulary.shared(w)), [0, 0])
        n[0] += c
        n[1] += 1
    for i, t in docs:
        alpha, want = None, 0.0
        for w in hmm.words_of(t) + [hmm.END]:
            k = kind.get(w, hmm.Vocabulary.shared(w))
            alpha = model.emit[k] * (model.start if alpha is None else alpha @ model.step)
            want += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
            if k >= hmm.OWN:
                n, v = size.get(k, (0, 0))
                want += math.log10((counts.get(w, 0) + 1) / (n + v + 1))
        assert math.isclose(got[i], want, rel_tol=1e-6), i


def test_base_scores_and_gain_of_the_model(spark):
    rng = random.Random(2)
    langs = [["the", "cat", "sat", "mat"], ["der", "hund", "und", "katze"]]
    docs = [(i, prose(rng, langs[i % 2], 40 + i % 9)) for i in range(300)] + [(900, None), (901, ""), (902, "UNSEEN the Word xİ"), (903, "A" * 100 + " the " + "A" * 100), (None, "the cat"), (3, "der hund")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    learn = F.coalesce(F.pmod("doc_id", F.lit(5)) != 2, F.lit(True))
    rows = hmm.score(df, learn).collect()
    assert len(rows) == len(docs)

    def tokens(t):
        return (t or "").encode().lower().split() + [b"\n"]

    counts = {}
    for i, t in docs:
        if i is None or i % 5 != 2:
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = {}
    for i, t in docs:
        w = tokens(t)
        want.setdefault(i, []).append((len(w), sum(x in counts for x in w), sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)))
    for r in rows:
        assert r.train_tokens == n
        assert any(r.n_tokens == a and r.n_known == b and math.isclose(r.base_score, c, rel_tol=1e-9) for a, b, c in want[r.doc_id])
        assert math.isfinite(r.score) and r.score < 0
    held = [r for r in rows if not r.learnt and r.doc_id < 300]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.score(df.limit(0), learn).count() == 0
    none = hmm.score(df, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in none)


