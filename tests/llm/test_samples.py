"""What models learn from: bounded samples, of rows that count once, and whole work where no bound applies."""

from collections import Counter

import numpy as np
import pyarrow as pa
from gristmill.llm import language, secrets, toxicity
from gristmill.llm.language import Model
from gristmill.llm.letters import LetterWords, find


def test_toxicity_learns_from_2500_of_each_class(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity.Model, "fit", classmethod(lambda cls, texts, label, *a: seen.update(n=len(texts), toxic=int(label.sum())) or cls.constant(0.5)))
    rows = spark.range(6600).selectExpr("id AS doc_id", "concat('text ', id) AS text", "CAST(id % 2 AS int) AS toxic")
    toxicity.fit_toxicity(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert seen["toxic"] >= 2500 and seen["n"] - seen["toxic"] >= 2500


def test_toxicity_bags_are_the_means_of_word_means():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "betas", "x", "alphabet"], 12)) for _ in range(9)] + ["", "--", "solo"]
    none = toxicity.Weights(np.zeros(0, np.uint64), np.zeros(0))
    x, used, scale = toxicity.Bags.build(pa.array(texts), none, 1)
    dense = np.zeros((len(texts), toxicity.PLACES))
    for d, text in enumerate(texts):
        running = [t for t in text.split() if t.isalpha()]
        for t in running:
            _, place = toxicity.subwords(LetterWords([t]))
            np.add.at(dense[d], place, 1 / len(place) / len(running))
    assert np.array_equal(used, np.flatnonzero(dense.any(0)))
    assert np.allclose(scale, np.sqrt((dense[:, used] ** 2).mean(0)))
    e, g = rng.normal(size=(len(used), 2)).astype(np.float32), rng.normal(size=(len(texts), 2)).astype(np.float32)
    assert np.allclose(x.means(e), dense[:, used] / scale @ e, atol=1e-5) and np.allclose(x.back(g), (dense[:, used] / scale).T @ g, atol=1e-5)
    some = np.arange(0, len(used), 2)
    assert np.allclose(x.only(some).means(e[some]), dense[:, used[some]] / scale[some] @ e[some], atol=1e-5)
    # a word's places are held once, however many documents have it
    more = toxicity.Bags.build(pa.array(texts * 5), none, 1)[0]
    assert len(more.words.col) == len(x.words.col) and len(more.docs.col) == 5 * len(x.docs.col)


def test_language_keeps_every_word_of_its_sample():
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    texts = [" ".join(word(i) for i in range(lo, lo + 1000)) for lo in range(0, 160_000, 1000)]
    model = Model.fit(texts, ["aa", "bb"] * (len(texts) // 2))
    assert len(model.tables[0][0]) == 160_000
    w = LetterWords(texts)
    assert (find(model.tables[0][0], w.hash) >= 0).all()


def test_language_samples_each_language(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language.Model, "fit", classmethod(lambda cls, texts, lang: seen.update(Counter(lang)) or cls([], [])))
    rare = "IF(id % 700 = 1, concat('r', id), 'aa')"
    rows = spark.range(14000).selectExpr("id AS doc_id", "IF(id % 2 = 0, NULL, concat('text ', id)) AS text", f"{rare} AS lang")
    want = rows.where("text IS NOT NULL AND crc32(cast(doc_id AS string)) % 4 != 2")
    have = {r.lang: r["count"] for r in want.groupBy("lang").count().collect()}
    language.fit_language(rows)
    assert seen == {k: min(n, seen[k]) for k, n in have.items()} and 4000 <= seen["aa"] <= 4400
    monkeypatch.setattr(language, "MAX_LABELLED", 100)
    seen.clear()
    language.fit_language(rows)
    assert set(seen) == set(have) and 100 <= seen["aa"] <= 130


def test_toxicity_weights_count_all_documents(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity.Model, "fit", classmethod(lambda cls, texts, label, share=None, weights=None: seen.update(weights=weights) or cls.constant(0.5)))
    docs = spark.range(1000).selectExpr("id AS doc_id", "IF(id < 10, 'vile', 'kind word')  AS text").union(spark.createDataFrame([(None, None)], "doc_id long, text string"))
    toxicity.fit_toxicity(docs, spark.range(20).selectExpr("id AS doc_id", "CAST(id < 10 AS int) AS toxic"))
    w = LetterWords(["vile", "kind word"])
    share = np.array([10, 990, 990]) / 1990
    text = ["vile", "kind", "word"]
    order = [int(np.flatnonzero(w.hash == LetterWords([t]).hash[0])[0]) for t in text]
    assert np.allclose(seen["weights"].of(w)[order], toxicity.RARE / (toxicity.RARE + share))


def test_secret_findings_of_both_labels_train(spark):
    made = secrets.labelled_findings(n=12000)
    by_label = sorted(made, key=lambda f: f[3])
    got = secrets.sample(by_label)
    assert Counter(f[3] for f in got) == {0: 4000, 1: 4000} and sorted(got) == sorted(secrets.sample(made))
    assert secrets.sample(made[:3000]) == made[:3000]
    assert any(not isinstance(t, float) for t in secrets.train(spark, by_label))


def test_repeated_ids_are_sampled_once(spark, monkeypatch):
    """One id 30,000 times, with as many texts: the driver sees one of them."""
    seen = {}
    monkeypatch.setattr(toxicity.Model, "fit", classmethod(lambda cls, texts, label, share, *a: seen.update(texts=texts.to_pylist(), label=label.tolist(), share=share) or cls.constant(0.5)))
    monkeypatch.setattr(language.Model, "fit", classmethod(lambda cls, texts, langs: seen.update(lang=list(zip(langs, texts.to_pylist(), strict=True))) or cls([], [])))
    rows = spark.range(30_000).selectExpr("1L AS doc_id", "concat('hot ', id) AS text", "'en' AS lang").unionAll(spark.range(2, 12).selectExpr("id", "concat('cold ', id)", "IF(id < 7, 'en', 'fr')"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (4, 1), (4, None), (None, 1), (777, 1)], "doc_id long, toxic int")
    toxicity.fit_toxicity(rows, labels, folds=10**9, held=-1)
    assert len(seen["texts"]) == 4 and sum(t.startswith("hot") for t in seen["texts"]) == 1
    assert seen["label"] == [0, 1, 0, 1] and seen["share"] == 0.5  # the lowest label of an id; none without a document
    language.fit_language(rows, folds=10**9, held=-1)
    assert len(seen["lang"]) == 11 and sum(t.startswith("hot") for _, t in seen["lang"]) == 1


def test_samples_are_bounded_in_bytes(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity.Model, "fit", classmethod(lambda cls, texts, *a: seen.update(n=len(texts)) or cls.constant(0.5)))
    monkeypatch.setattr(language.Model, "fit", classmethod(lambda cls, texts, langs: seen.update(lang=len(texts)) or cls([], [])))
    rows = spark.range(400).selectExpr("id AS doc_id", "repeat('x', 1000) || id AS text", "'en' AS lang", "CAST(id % 2 AS int) AS toxic")
    monkeypatch.setattr(toxicity, "MAX_BYTES", 50_000)
    monkeypatch.setattr(language, "MAX_BYTES", 100_000)
    toxicity.fit_toxicity(rows, rows.select("doc_id", "toxic"))
    assert seen["n"] == 2 * (50_000 // 1003)
    language.fit_language(rows)
    assert 20 < seen["lang"] < 120
