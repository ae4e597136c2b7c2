"""The index against plain numpy: recall on clustered and on shapeless vectors, filters, slices and blocks."""

import numpy as np
import pyarrow as pa
import pytest
from gristmill.operators import vector_index as V
from pyspark.sql import functions as F


def table(spark, vectors, repeat=1):
    return spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)], "id long, e array<float>, kind int").repartition(4)


def truth(vectors, ids, k, allowed=None):
    x = np.asarray(vectors, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in ids:
        score = np.round(x @ x[q], 12)
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q and (allowed is None or allowed(i))]
        out[q] = order[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.q, -r.cosine, r.neighbour)):
        out.setdefault(r.q, []).append(r.neighbour)
    return out


def recall(got, want):
    return sum(len(set(got.get(q, [])) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_and_pruning(spark, tmp_path, clustered):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    vectors = np.repeat(base, 40, axis=0) + 0.2 * rng.normal(size=(1200, 16)) if clustered else rng.normal(size=(1200, 16))
    rows = table(spark, vectors)
    index = V.build(rows, str(tmp_path / "i"), "id", "e", ("kind",))
    queries = rows.where("id % 10 = 0").select(F.col("id").alias("q"), F.col("e").alias("v"))
    want = truth(vectors, range(0, 1200, 10), 10)
    assert recall(found(index.search(queries, 10)), want) >= 0.9
    assert index.probes < len(index.centres) / 3 if clustered else index.probes <= len(index.centres)
    assert found(index.search(queries, 10, probes=len(index.centres))) == want


def test_filter_before_the_probe(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "SLICE", 50)
    monkeypatch.setattr(V, "QUERIES", 7)
    vectors = np.random.default_rng(2).normal(size=(300, 8))
    rows = table(spark, vectors)
    index = V.build(rows, str(tmp_path / "i"), "id", "e", ("kind",), cells=3)
    assert max(index.slices.values()) > 1
    queries = rows.where("id < 30").select(F.col("id").alias("q"), F.col("e").alias("v"))
    got = found(index.search(queries, 5, F.col("kind") == 1, probes=3))
    assert got == truth(vectors, range(30), 5, lambda i: i % 3 == 1)
    plan = index.search(queries, 5, F.col("kind") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,1)" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [1.0, 0.0])], "id long, e array<float>")
    index = V.build(rows, str(tmp_path / "i"), "id", "e")
    queries = rows.select(F.col("id").alias("q"), F.col("e").alias("v")).where("q IS NOT NULL")
    assert found(index.search(queries, 1, probes=9))[1] == [4]
    assert index.search(queries.limit(0), 3).count() == 0
    assert V.build(rows.limit(0), str(tmp_path / "j"), "id", "e").search(queries, 3).count() == 0


def test_cells_and_scores_are_computed_in_bounded_parts(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(500, 8))
    vectors[100:160] = vectors[100]  # ties
    monkeypatch.setattr(V, "OUT", 64)
    monkeypatch.setattr(V, "SCORES", 999)
    assign = V._assigning(V.centres(V._matrix(pa.array(vectors.tolist())), 20), 20)
    out = list(assign(iter([pa.record_batch({"v": pa.array(vectors.tolist())})])))
    assert max(b.num_rows for b in out) <= 64 and sum(b.num_rows for b in out) == 500 * 20
    q = V._matrix(pa.array(vectors[90:110].tolist()))
    row, at, _, cosine = (np.concatenate(x) for x in zip(*V.best(np.arange(90, 110), q, np.arange(500), V._matrix(pa.array(vectors.tolist())), 7, 12), strict=True))
    assert {90 + i: list(at[row == i]) for i in range(20)} == truth(vectors.astype(np.float64), range(90, 110), 7)
