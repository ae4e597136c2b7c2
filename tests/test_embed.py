"""Embedder plumbing, run history, ordered batches, nearest vectors."""

import pytest
from gristmill.operators import documents as D
from gristmill.operators.collection import COLLECTION, internal_documents
from gristmill.operators.embed import FakeEmbedder, OpenAIEmbedder, RateLimited, Settings, attach_vectors, checked, embed_batches, with_retry
from gristmill.operators.ordered import batches
from gristmill.operators.similarity import nearest


def test_batches_keep_order_and_sizes():
    seen = []

    def embed(texts):
        seen.append(len(texts))
        return [[float(t)] for t in texts]

    assert embed_batches(embed, list("01234"), 2) == [[0.0], [1.0], [2.0], [3.0], [4.0]] and seen == [2, 2, 1]
    assert embed_batches(embed, [], 2) == []
    with pytest.raises(ValueError, match="Inconsistent"):
        embed_batches(lambda t: [[0.0] * len(t[0])], ["a", "bb"], 1)
    with pytest.raises(ValueError, match="vectors for"):
        embed_batches(lambda t: [], ["a"], 1)


def test_retries():
    waits, calls = [], []

    def limited(texts):
        calls.append(1)
        raise RateLimited("slow down")

    with pytest.raises(RateLimited):
        with_retry(limited, sleep=waits.append)(["a"])
    assert waits == [2, 4, 8, 16, 32] and len(calls) == 6
    waits.clear()

    def broke(texts):
        raise RateLimited("insufficient_quota")

    with pytest.raises(RateLimited):
        with_retry(broke, sleep=waits.append)(["a"])
    assert waits == []


def test_attach_custom_embedder(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(1, 30)], "pos long, text string")
    out = attach_vectors(docs, lambda texts: [[float(len(t)), 1.0] for t in texts], 7, 20).collect()
    assert all(r.vector == [float(min(len(r.text), 20)), 1.0] for r in out)
    uneven = attach_vectors(docs.repartition(4), lambda texts: [[0.0] * (1 + len(texts[0]) % 2)] * len(texts), 1)
    with pytest.raises(Exception, match="Inconsistent"):
        checked(uneven)


def test_history(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "id string, v int")
    assert sorted(map(tuple, D.upsert(rows, spark.createDataFrame([("a", 2), ("c", 1)], "id string, v int"), "id", "v").collect())) == [("a", 3), ("b", 2), ("c", 1)]
    assert sorted(r.v for r in D.expired(rows, "v", 2).collect()) == [1]


def test_ordered_batches(spark):
    ids = spark.range(0, 1000).repartition(7).withColumnRenamed("id", "pos")
    assert all(r.batch == r.pos // 100 for r in batches(ids, 100).collect())
    assert batches(ids.limit(0), 100).count() == 0


def test_nearest(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    got = nearest(v.where("vec_id = 0"), v, 2).orderBy("neighbour").collect()
    assert [r.neighbour for r in got] == [1, 2]


def test_settings():
    with pytest.raises(ValueError, match="OPENAI_API_KEY"):
        Settings.read({}).embedder()
    assert isinstance(Settings.read({"USE_FAKE_EMBEDDINGS": "1"}).embedder(), FakeEmbedder) and Settings.read({}).max_chars == 8000
    assert isinstance(Settings.read({"OPENAI_API_KEY": "k"}).embedder(), OpenAIEmbedder)
    assert isinstance(Settings.read({"OPENAI_API_KEY": "k", "USE_FAKE_EMBEDDINGS": "1"}).embedder(), FakeEmbedder)
    assert Settings.read({"MAX_EMBEDDING_CHARS": "5"}).max_chars == 5
    with pytest.raises(ValueError, match="OPENAI_API_KEY"):
        OpenAIEmbedder(None)


def test_collection_helpers(spark):
    from pyspark.sql import functions as F

    raw = spark.createDataFrame([(0, '{"id": "a", "_id": "b", "headlines": {"basic": "T"}, "canonical_url": "u", "created_date": "d"}'), (1, '{"_id": 5, "headlines": 1, "title": "X"}')], "pos long, j string").select("pos", F.parse_json("j").alias("doc"))
    got = internal_documents(raw).orderBy("pos").collect()
    assert [(r.external_id, r.title, r.url, r.published_at) for r in got] == [("a", "T", "u", "d"), ("5", "X", None, None)]
    assert COLLECTION["size"] == 1536
