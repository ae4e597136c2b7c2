"""Ranked search against a plain scoring of every document for every item."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest import lower_ascii

from gristmill.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [(1, "the THE onth re!an"), (2, "zzz-none"), (3, None), (4, ""), (5, "one two words q"), (None, "an er on"), (7, "x y z x"), (1, "the THE onth re!an"), (8, "he"), (8, "nd he")]


def terms(t):
    return TERM.findall(lower_ascii(t or ""))


def brute(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, []).extend(terms(t))
    out = []
    for i, ts in asked.items():
        found = []
        for d, c in own:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("k", [1, 10])
def test_equals_plain_scores(spark, docs, corpus, k):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'clash' AS score", "'clash' AS code")
    assert rows(R.ranked_search(docs, items, k)) == brute(corpus, ITEMS, k)


def test_small_shards_blocks_and_repeated_ids(spark, corpus, monkeypatch):
    monkeypatch.setattr(R, "SHARD_BYTES", 2000)
    monkeypatch.setattr(R, "ITEM_TERMS", 4)
    own = corpus + [(i % 3 if i % 5 else None, t) for i, t in corpus[:40]] + [(7, "the re an onth the")] * 13
    df = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    assert rows(R.ranked_search(df, spark.createDataFrame(ITEMS, "item_id long, text string"), 10)) == brute(own, ITEMS, 10)


def test_rounds_fetch_less_and_lose_nothing():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m, k = int(rng.integers(5, 60)), int(rng.integers(1, 6)), int(rng.integers(1, 5))
        lists, exact = [], np.zeros(n, np.int64)
        for _ in range(m):
            docs = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
            impact, w = rng.integers(1, 50, len(docs)), int(rng.integers(1, 9))
            lists.append((w, docs, impact))
            exact[docs] += w * impact
        best = np.sort(exact)[::-1]
        bound = int(best[k - 1] * rng.random()) if rng.random() < 0.9 else int(best[k - 1])
        at, score = R.fetch(lists, bound, m, n, k)
        assert (score == exact[at]).all()
        assert set(np.flatnonzero((exact >= best[k - 1]) & (exact > 0))) <= set(at)


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert not rows(R.ranked_search(docs, none)) and not rows(R.ranked_search(empty, some))
