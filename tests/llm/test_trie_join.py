import time
from collections import Counter

import numpy as np
from conftest_llm import lower_ascii, words
from gristmill.llm import components, trie_join
from gristmill.llm.components import connected_components
from gristmill.llm.trie_join import jaccard_components, link_groups, one_of_each
from pyspark.sql import functions as F


def sets_of(rows):
    out = {}
    for d, t in rows:
        w = words(lower_ascii(t or ""))
        out[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(rows):
    s = sets_of(rows)
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s[d]), find(d)) for d in s}


def test_equals_brute_force(docs, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == brute(corpus)
    assert max(Counter(c for _, c in got.values()).values()) >= 2


def test_chunks_of_a_large_group_lose_nothing(docs, corpus, monkeypatch):
    monkeypatch.setattr(trie_join, "CHUNK_SETS", 2)
    monkeypatch.setattr(trie_join, "CHUNK_HASHES", 150)
    assert {r.doc_id: r.component_id for r in jaccard_components(docs).collect()} == {d: c for d, (_, c) in brute(corpus).items()}


def test_trie_equals_all_pairs():
    rng = np.random.default_rng(1)
    for size in (3, 20, 60):
        base = [rng.integers(0, 2000, rng.integers(1, 40)) for _ in range(6)]
        sets = []
        for _ in range(size):
            b = base[rng.integers(6)]
            sets.append(np.unique(np.concatenate([b[rng.random(len(b)) < 0.9], rng.integers(0, 2000, 2)])).astype(np.uint64))
        label = link_groups(sets, 75)
        want = np.arange(size)
        for i in range(size):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    want[want == want[i]] = want[j]
        assert ((label[:, None] == label) == (want[:, None] == want)).all()


def test_components(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (60, 50), (60, 51), (51, 59)]
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {i: 50 for i in (50, 51, 59, 60)}
    for few in (components.FEW_EDGES, 0):  # in one task, and by stars
        monkeypatch.setattr(components, "FEW_EDGES", few)
        assert {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()} == want
    monkeypatch.setattr(components, "FEW_EDGES", 10)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_keeps_rows_whole(docs, corpus):
    want = {d for d, (_, c) in brute(corpus).items() if c == d}
    got = one_of_each(docs)
    assert {r.doc_id for r in got.collect()} == want and got.columns == docs.columns


def test_odd_rows(spark, empty):
    assert jaccard_components(empty).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None), (5, ""), (6, "a b"), (7, "A B")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 2, None), (3, 2, None), (3, 2, None), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6)]
    # the long text, 4, 5, "a b" and "other"
    assert one_of_each(spark.createDataFrame(rows + [(None, "other")], "doc_id long, text string")).count() == 5


def test_repeated_ids_are_one_node(spark, corpus):
    ids = [None if i % 29 == 5 else i // 2 if i % 7 == 3 else i for i, _ in corpus]
    rows = list(zip(ids, [t for _, t in corpus], strict=True))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    low = lambda d: -1 if d is None else d
    sets = list(sets_of(list(enumerate(t for _, t in rows))).values())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = ids[i] == ids[j] or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))
            if same:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), low(d)), low(d))
    assert sorted((low(d), n, low(c)) for d, n, c in got) == sorted((low(d), len(s), least[find(i)]) for i, (d, s) in enumerate(zip(ids, sets, strict=True)))


def test_a_template_that_does_not_link_costs_little(spark):
    template = " ".join(f"t{i}" for i in range(24))
    rows = [(i, template + " " + " ".join(f"u{i}_{j}" for j in range(6))) for i in range(8000)]
    began = time.time()
    assert jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id != component_id").count() == 0
    assert time.time() - began < 30


def test_one_of_each_judges_rows_by_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a, 1), (3, b, 2), (None, b + " more", 3), (None, a, 4), (9, a, 5), (9, a, 5), (10, "", 6), (None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int").withColumns({c: F.lit(1) for c in ("row", "kept_row", "kept_doc_id", "full", "nth", "node", "id", "th")})
    got = one_of_each(df)
    assert got.columns == df.columns
    # one row of each text group stays, and what has no words
    assert sorted(r.kept for r in got.collect()) == [3, 4, 6, 7]
