import itertools
import random

import numpy as np

from strata.llm import near_dedup


def brute(docs, width, percent):
    sets = []
    for _, t in docs:
        w = t.encode().lower().split() if t else []
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(i)
    return sets, groups


def corpus(seed, n_groups=12, edits=(0, 2, 5, 9, 14, 20, 30)):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(n_groups):
        base = rng.choices(words, k=rng.randint(60, 160))
        for e in edits:
            own = list(base)
            for _ in range(e):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs.append(" ".join(own))
    docs += ["", " \n", None, None, "Short", "short", "two words", "TWO words", "É x y z a", "é x y z a", "a\x0bb c d", "a b c d"]
    return list(enumerate(docs))


def test_components_against_brute_force(spark):
    docs = corpus(1) + [(5000 + i, "the same text again and again here") for i in range(30)] + [(5000, "the same text again and again here")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, ROW int")
    for width, percent in ((4, 80), (5, 80)):
        sets, groups = brute(docs, width, percent)
        want = {}
        for members in groups.values():
            least = min(docs[m][0] for m in members)
            want.update({docs[m][0]: (len(sets[m]), least) for m in members})
        got = near_dedup.near_duplicates(df, width, percent).collect()
        assert len(got) == len(docs)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.keep_one(df, 4).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(docs[m][0] for m in g) for g in brute(docs, 4, 80)[1].values())
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_divided_regions(spark, monkeypatch):
    """Small limits force long prefixes, hash parts and the second round on one large group; no link is lost."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(260):
        own = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 6, 9))):
            own[rng.randrange(len(own))] = f"x{rng.random()}"
        docs.append((i, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    _, groups = brute(docs, 4, 80)
    want = {docs[m][0]: min(g) for g in groups.values() for m in g}
    for rows, shingles in ((1024, 3000), (12, 1 << 19)):
        monkeypatch.setattr(near_dedup, "ROWS", rows)
        monkeypatch.setattr(near_dedup, "SHINGLES", shingles)
        assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 4).collect()} == want


def test_links_of_a_block_against_brute_force():
    """The spanning forest joins just what all pairs join, in one role and between two, given components or not."""
    rng = random.Random(5)
    for trial in range(60):
        sets = [np.unique(np.array(rng.sample(range(60), rng.randint(1, 50)), np.uint64)) for _ in range(rng.randint(2, 25))]
        role = np.array([rng.random() < 0.4 for _ in sets], int) if trial % 2 else np.zeros(len(sets), int)
        comp = [rng.randrange(8) if trial % 3 == 0 else -i for i in range(len(sets))]

        def joined(pairs):
            label = list(comp)
            for a, b in pairs:
                if label[a] != label[b]:
                    old, new = label[a], label[b]
                    label = [new if x == old else x for x in label]
            return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}

        def alike(a, b):
            both = len(np.intersect1d(sets[a], sets[b]))
            return 100 * both >= 60 * (len(sets[a]) + len(sets[b]) - both)

        links = [(i, j) for i, hit in near_dedup.linked(sets, role, comp, 60) for j in hit]
        assert all(alike(a, b) for a, b in links) and len(links) < len(sets)
        assert joined(links) == joined([p for p in itertools.combinations(range(len(sets)), 2) if alike(*p) and (not role.any() or role[p[0]] != role[p[1]])])


def test_large_regions_stay_whole(spark, monkeypatch):
    """Copies near their origin alone, in regions of several times REGION rows: every link is found."""
    rng = random.Random(9)
    docs = []
    base = [f"b{i}" for i in range(400)]
    docs.append(" ".join(base))
    for i in range(120):
        own = list(base)
        for at in rng.sample(range(0, 400, 4), 9):
            own[at] = f"x{i}.{at}"
        docs.append(" ".join(own))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    monkeypatch.setattr(near_dedup, "ROWS", 32)
    _, groups = brute(docs, 4, 80)
    want = {m: min(g) for g in groups.values() for m in g}
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_long_texts_and_kept_columns(spark):
    """A text of 60,000 words and its copy; a table whose columns have the operator's own names; repeated rows."""
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, long, "a", 1), (2, long + " end", "b", 2), (2, long + " end", "b", 2), (3, "x y z", None, None), (3, "x y z", None, None), (4, "", "", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __row string, __gone int")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()) == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (3, 3, True), (4, 4, True)]
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r["__row"]) for r in kept.collect()) == [(1, "a"), (3, None), (4, "")]


def test_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, "q r s t u v"), (None, None)], "doc_id bigint, text string")
    got = sorted((r.component_id is None, r.kept, r.doc_id) if r.doc_id is not None else (r.component_id is None, r.kept, -1) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(False, False, -1), (False, False, -1), (False, True, 3), (True, True, -1), (True, True, -1)]
    assert near_dedup.keep_one(df).count() == 3
