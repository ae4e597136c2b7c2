"""Language ID, toxicity and quality: held-out accuracy on the driver's tables, base rules by brute force, odd rows."""

import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import crc_fold, words
from gristmill.llm import language, quality, toxicity
from gristmill.llm.language import Model, language_id
from gristmill.llm.letters import LetterWords
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@needs_tables
def test_language_on_held_out_documents(tables):
    got = language_id(tables[0]).join(tables[0].select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (crc_fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) > 100


def test_language_odd_rows(spark, empty):
    assert language_id(empty).count() == 0
    rows = [(0, "the house and the tree", "en"), (1, "das Haus und der Baum", "de"), (3, None, "en"), (4, "12 -- !", None), (5, "Baume", None), (7, "", "en")]
    got = {r.doc_id: r for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))).collect()}
    assert [got[d].lang_pred for d in (3, 4, 7)] == ["und"] * 3 and got[3].score == 0
    assert got[5].lang_pred in ("de", "en")
    assert all(r.lang_pred == "und" for r in language_id(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect())


@needs_tables
def test_toxicity_on_held_out_documents(tables):
    got = toxicity.toxicity(*tables).join(tables[1].select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.held_out == (crc_fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    rank = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in held if a.toxic for b in held if not b.toxic]
    assert np.mean(rank) > 0.75 and np.mean([r.predicted for r in held if not r.toxic]) < 0.05


def test_toxicity_learns_misspellings():
    rng = np.random.default_rng(0)
    plain = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)) for _ in range(300)]
    label = (np.arange(300) % 5 == 0).astype(np.float32)
    texts = [t + " what a despicable moronic lot" if y else t for t, y in zip(plain, label, strict=True)]
    m = toxicity.Model.fit(texts, label)
    s = m.score(pa.array([plain[1], plain[1] + " despicabel moronicc ones", "", None]))
    assert s[0] < 0.5 < s[1] and s[2] == s[3]


def test_toxicity_odd_rows(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(empty, labels).count() == 0
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (3, "...")], "doc_id long, text string").withColumn("label", F.lit("x"))
    one_class = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(rows, labels).count() == 4 and {r.predicted for r in toxicity.toxicity(rows, one_class).collect()} == {1}
    assert toxicity.keep_clean(rows, labels).columns == rows.columns


def statistics(t):
    w = words(t)
    seen, lines = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(len(x.decode()) for x in w), sum(x in "#*$%&|<>" for x in t or ""), lines, len(cover)


def test_base_statistics(spark, docs, corpus):
    text = dict(corpus)
    rows = quality.quality_filter(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    for r in rows:
        n, chars, symbols, lines, repeats = statistics(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and r.kept == (not r.base_failed)
    assert len(rows) == len(corpus)


@needs_tables
def test_quality_against_labels_held_out(tables):
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = quality.quality_filter(tables[0], tables[1].where(~held)).join(tables[1].where(held).select("doc_id", "quality"), "doc_id").where("NOT base_failed").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert len(good) > 20 and np.mean(good) > 0.94 and np.mean(bad or [0]) < 0.2


def test_forest_equals_plain_recursion():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 7))
    forest = quality.IsolationForest(trees=20).fit(x, x.min(0), x.max(0))
    c = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def path(tree, row, at=0):
        f, cut, left, right, length = (column[at] for column in tree)
        return length if f < 0 else path(tree, row, left if row[f] < cut else right)

    rows = np.concatenate([x[:20], rng.normal(size=(20, 7)) * 4])
    want = [2 ** (-np.mean([path(t, r) for t in forest.nodes]) / c(256)) for r in rows]
    assert np.allclose(forest.score(rows), want) and forest.score(rows)[20:].mean() > forest.score(rows)[:20].mean()


def test_threshold_takes_the_best_cut():
    rng = np.random.default_rng(4)
    good, bad = rng.integers(0, 40, 500), rng.integers(25, 60, 80)
    cut = quality.calibrated(np.bincount(good, minlength=quality.CLASSES), np.bincount(bad, minlength=quality.CLASSES), 0.2) * quality.CLASSES
    gain = lambda t: np.mean(bad >= t) - np.mean(good >= t)
    assert np.mean(good >= cut) <= 0.2 and gain(cut) == max(gain(t) for t in range(61) if np.mean(good >= t) <= 0.2)
    assert quality.calibrated(np.zeros(quality.CLASSES), np.ones(quality.CLASSES), 0.1) == 2.0


def test_quality_ties_repeated_rows_and_extra_columns(spark):
    texts = [" ".join(f"w{i}_{j}" for j in range(80)) for i in range(30)] + [" ".join(f"#$%{i}{j}" for j in range(80)) for i in range(10)]
    rows = [(i, t) for i, t in enumerate(texts)] * 2 + [(None, texts[0]), (99, None), (98, "x " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("label", "n_words", "kept", "quality", "place")})
    labels = spark.createDataFrame([(i, int(i < 30), 1) for i in range(40)] * 2 + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, label int")
    got = quality.quality_filter(docs, labels).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.kept, r.anomaly))
    assert all(len(v) == 1 for v in by.values()) and by[None] == by[0]
    assert all(k for i in range(30) for k, _ in by[i]) and not any(k for i in range(30, 40) for k, _ in by[i])


def test_language_equals_plain_backoff():
    texts, lang = ["the house the tree", "das haus der baum", "una casa un arbol"], ["en", "de", "es"]
    model, langs = Model.fit(texts, lang), sorted(set(lang))
    tables = [Counter() for _ in range(6)]
    for t, k in zip(texts, lang, strict=True):
        for w in t.split():
            tables[0][w, k] += 1
            for n in range(1, 6):
                for i in range(len(w) + 3 - n):
                    tables[n][f"<{w}>"[i : i + n], k] += 1

    def row(n, key):
        own = {x for x, _ in tables[n]}
        if key not in own:
            return None
        total = {k: sum(c for (_, l), c in tables[n].items() if l == k) for k in langs}
        s = np.array([math.log((tables[n][key, k] + 0.5) / (total[k] + 0.5 * (len(own) + 1))) for k in langs])
        return s - np.log(np.exp(s).sum())

    def word(w):
        if (s := row(0, w)) is not None:
            return s
        for n in range(5, 0, -1):
            found = [s for i in range(len(w) + 3 - n) if (s := row(n, f"<{w}>"[i : i + n])) is not None]
            if found:
                return np.mean(found, 0)
        return np.zeros(len(langs))

    own = ["the houses baumhaus", "zzz", "casa casa tree", "qq un"]
    best, share = model.predict(pa.array(own))
    for t, b, p in zip(own, best, share, strict=True):
        s = sum(word(w) for w in t.split())
        assert b == s.argmax() and math.isclose(p, 1 / np.exp(s - s.max()).sum(), rel_tol=1e-9)


def test_tally_adds_up_whatever_waits(monkeypatch):
    rng = np.random.default_rng(2)
    for pending in (0, 50, 10**6):
        monkeypatch.setattr(language, "PENDING", pending)
        tally, want = language.Tally(), Counter()
        for _ in range(40):
            keys = np.unique(rng.integers(0, 300, 60)).astype(np.uint64)
            many = rng.integers(1, 9, len(keys))
            tally.add(keys, many)
            want.update(dict(zip(keys.tolist(), many.tolist(), strict=True)))
        keys, many = tally.total()
        assert keys.tolist() == sorted(want) and dict(zip(keys.tolist(), many.tolist(), strict=True)) == want


def test_language_ties_repeated_and_long_texts(spark):
    rows = [(0, "same words here", "en"), (1, "same words here", "de"), (3, "same words", None), (3, "same words", None), (4, "same " * 100_000, None)]
    got = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"place": F.lit(1), "held_out": F.lit(1)})).collect()
    assert len(got) == 5 and {r.lang_pred for r in got} == {"de"}  # a tie goes to the first in the alphabet


def test_toxicity_equals_plain_sums():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abc "), 60)) for _ in range(120)]
    label = np.array(["abca" in t for t in texts], np.float32)
    model = toxicity.Model.fit(texts, label)
    for t in [*texts[:10], "", "abcabc cab", "ABCA"]:
        w = LetterWords([t.lower()])
        word, place = toxicity.subwords(w)
        total, mass = 0.0, 0.0
        for i in w.which:  # each running word: the mean of its places, weighted by how rare it is
            at = np.searchsorted(model.weights.hashes, w.hash[i])
            own = model.weights.weight[at] if at < len(model.weights.hashes) and model.weights.hashes[at] == w.hash[i] else 1.0
            total += own * np.mean([model.places[p] for x, p in zip(word, place, strict=True) if x == i])
            mass += own
        want = 1 / (1 + math.exp(-(model.bias + (total / mass if mass else 0.0))))
        assert math.isclose(model.score(pa.array([t]))[0], want, rel_tol=1e-5)


def test_clean_keeps_what_it_cannot_judge(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "...")], "doc_id long, text string")
    one_class = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.keep_clean(rows, one_class).count() == 4


def test_quality_empty(spark, empty):
    assert quality.quality_filter(empty, spark.createDataFrame([(1, 0)], "doc_id long, quality int")).count() == 0
