"""Mixing against plain resharing, and rates found by bisection."""

import math
import random
from collections import Counter, defaultdict

import pytest
from conftest import words
from pyspark.sql import functions as F

from gristmill.llm import mixing as M


def plain_targets(sizes, percent=150, cap=2):
    """Resharing the excess again and again; sizes by source, None last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, rest, open_ = dict.fromkeys(sizes, 0.0), sum(sizes.values()) * percent / 100, set(order)
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        over = 0.0
        for s in list(open_):
            out[s] += rest * weight[s] / total
            if out[s] >= cap * sizes[s]:
                over += out[s] - cap * sizes[s]
                out[s] = float(cap * sizes[s])
                open_.discard(s)
        rest = over
    return out


def plain_rates(own, target, cap=2):
    """Rates of the words of one source by bisection."""
    own = [n for n in own if n]
    if target >= cap * sum(own):
        return lambda n: float(cap)
    mean = sum(own) / len(own)
    lo, hi = -1e4, 1e4
    for _ in range(300):
        mid = (lo + hi) / 2
        got = sum(n * min(cap, math.exp(min(mid * n / mean, 50))) for n in own)
        lo, hi = (mid, hi) if got < target else (lo, mid)
    return lambda n: min(cap, math.exp(min(lo * n / mean, 50)))


def check(rows, docs):
    """rows: doc_id, size, source_size, target, taken; docs: doc_id, text, source with ids of their own."""
    text = {i: (t, s) for i, t, s in docs}
    assert sorted(r[0] for r in rows) == sorted(text)
    sizes, by = defaultdict(int), defaultdict(list)
    for i, size, *_ in rows:
        assert size == len(words(text[i][0]))
        sizes[text[i][1]] += size
    want = plain_targets(sizes)
    for i, size, source_size, target, taken in rows:
        s = text[i][1]
        assert source_size == sizes[s] and target == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert taken == 0 if not size else taken % size == 0 and 0 <= taken <= 2 * size
        by[s].append((size, taken))
    for s, own in by.items():
        assert abs(sum(t for _, t in own) - want[s]) <= max(1, max(n for n, _ in own) / 2)
        rate = plain_rates([n for n, _ in own], want[s])
        n_of, copies = Counter(n for n, _ in own if n), Counter()
        for n, t in own:
            if n:
                copies[n] += t // n
        due = done = 0.0
        for n in sorted(n_of):
            due, done = due + n_of[n] * rate(n), done + copies[n]
            assert abs(due - done) <= 1.001 + M.REPAIRS  # so far, in the order of sizes
        for n in n_of:
            each = {t // n for m, t in own if m == n}
            assert max(each) - min(each) <= 1


def table(seed=5):
    rng, out = random.Random(seed), []
    for i in range(400):
        s = rng.choice(["a", "a", "a", "b", "Z", "é", None, "c"])
        out.append((i, " ".join("w" * 3 for _ in range(rng.choice([1, 5, rng.randint(1, 400)]))), s))
    out += [(1000 + i, "same text of seven words in it", "a") for i in range(300)]
    return out + [(5000, None, "a"), (5001, " \t\n", "b"), (5002, "", "empty"), (5003, None, None), (5004, "big " * 9000, "Z"), (5005, "x\x85y one\x0btwo", "")]


def result(df):
    return sorted(map(tuple, df.select("doc_id", "size", "source_size", "target", "taken").collect()))


@pytest.mark.parametrize("group", [10_000, 7])
def test_targets_rates_and_copies(spark, monkeypatch, group):
    monkeypatch.setattr(M, "GROUP", group)
    docs = table()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("key", "size", "n", "target", "h", "part")})
    rows = result(M.mixed(df.repartition(3)))
    check(rows, docs)
    assert rows == result(M.mixed(df.repartition(7, "text")))


def test_joins_without_broadcasts(spark, monkeypatch):
    from gristmill.llm import blocks

    docs = table(6)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    want = result(M.mixed(df))
    monkeypatch.setattr(M, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(blocks, "BROADCAST_ROWS", 1)
    assert result(M.mixed(df)) == want


def test_repeated_and_missing_ids(spark):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (1, "a b c", "s"), (1, "d e", "t"), (1, "d e", "t")]
    got = M.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r["size"] for r in got) == [2, 2, 3, 3, 3] and all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)


def test_no_words_and_no_rows(spark, empty):
    assert result(M.mixed(empty)) == []
    rows = spark.createDataFrame([(1, None, None), (2, " ", "s")], "doc_id long, text string, source string")
    assert result(M.mixed(rows)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_plan_is_native(spark, docs):
    plan = M.mixed(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
