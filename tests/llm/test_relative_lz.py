import hashlib

import numpy as np
from conftest_llm import words
from gristmill.llm import relative_lz
from gristmill.llm.blocks import LARGEST_BLOCK, block_count, split
from gristmill.llm.relative_lz import substring_dedup
from gristmill.llm.words import Words


def brute(rows, k):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            if x in seen:
                gone[i : i + k] = [True] * k
            seen.add(x)
        kept = b" ".join(a for a, b in zip(w, gone, strict=True) if not b)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def test_equals_brute_force(docs, corpus):
    for k in (20, 7):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring_dedup(docs, k).collect()}
        assert got == brute(corpus, k)


def test_factors_point_at_equal_words(docs, corpus):
    text = {d: words(t) for d, t in corpus}
    found = 0
    for r in substring_dedup(docs).collect():
        for f in r.factors:
            assert f.length >= 20 and (f.source_id, f.source_start) < (r.doc_id, f.start)
            assert text[r.doc_id][f.start : f.start + f.length] == text[f.source_id][f.source_start : f.source_start + f.length]
            found += 1
    assert found > 20


def test_odd_rows(spark, empty):
    assert substring_dedup(empty).count() == 0
    rows = [(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None)]
    got = sorted((r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect())
    assert got == [(0, 0), (4, 0), (4, 4), (4, 4), (4, 4)]


def test_hot_anchors_are_dealt_by_windows(docs, corpus, monkeypatch):
    monkeypatch.setattr(relative_lz, "HOT", 2)
    assert {r.doc_id: r.kept_text for r in substring_dedup(docs).collect()} == {d: x[3] for d, x in brute(corpus, 20).items()}


def passages(texts):
    data = " ".join(texts).encode()
    ends = np.cumsum([len(t) + 1 for t in texts])
    return Words(np.frombuffer(data + b" ", np.uint8), np.concatenate([[0], ends]))


def test_factors_are_extended_and_checked(monkeypatch):
    w = passages(["a b c d e f", "x a b c d e", "c d e f a b c d"])
    spans = lambda got: sorted((int(p), int(j), int(n)) for p, j, n, *_ in zip(*got, strict=True))
    order = np.arange(3)
    assert spans(relative_lz.factors(w, 3, order)) == [(1, 1, 3), (2, 0, 2), (2, 4, 2)]
    # without the extension a factor is one window, and the next one is found by a search of its own
    greedy = relative_lz._greedy
    monkeypatch.setattr(relative_lz, "_greedy", lambda *a: tuple(x[:1] for x in greedy(*a)))
    assert spans(relative_lz.factors(w, 3, order)) == [(1, 1, 3)]
    monkeypatch.setattr(relative_lz, "_greedy", greedy)
    # a hash that takes different windows for equal ones does no harm
    monkeypatch.setattr(Words, "windows", lambda self, k, own=Words.windows: (own(self, k)[0], own(self, k)[1] % np.uint64(3)))
    covered = {(p, j + i) for p, j, n in spans(relative_lz.factors(w, 3, order)) for i in range(n)}
    assert covered == {(1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 4), (2, 5)}


def test_result_comes_from_the_parse(docs, corpus, monkeypatch):
    monkeypatch.setattr(relative_lz, "factors", lambda w, window, rank: (np.zeros(0, np.int64),) * 5)
    assert {r.doc_id: r.kept_text for r in substring_dedup(docs).collect()} != {d: x[3] for d, x in brute(corpus, 20).items()}


def test_rows_of_one_id_in_several_blocks(spark):
    w = [f"w{i}" for i in range(80)]
    rows = [(7, " ".join(w[:40])), (7, " ".join(w[20:])), (7, " ".join(w[20:])), (None, " ".join(w[30:60])), (3, "")]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    by = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in got.collect())
    # the null id comes first; either text of id 7 may be the earlier one, and its third row equals another
    assert by[:2] == [(-1, 30, 0), (3, 0, 0)]
    assert sorted(x[2] for x in by[2:]) in ([30, 50, 60], [0, 50, 60], [0, 40, 60], [0, 30, 60], [20, 30, 60])


def test_messages_grow_with_the_text():
    assert block_count(0, 8) == 8 and block_count(1 << 30, 8) == 128
    assert block_count(100 << 40, 200) * LARGEST_BLOCK >= 100 << 40
    h = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    assert all(len(split(h, n)) <= min(n, len(h)) for n in (50, 200, 2000, 100_000))
