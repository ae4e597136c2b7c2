"""Nearest vectors, scored by blocks: small slices and blocks, ties, vectors without a cosine."""

import numpy as np
from gristmill.operators import similarity as S
from pyspark.sql import functions as F


def test_small_slices_and_blocks_are_brute_force(spark, monkeypatch):
    for name, value in (("SLICE", 40), ("BLOCK", 7), ("SCORES", 100)):
        monkeypatch.setattr(S, name, value)
    x = np.random.default_rng(3).integers(-2, 3, (400, 3)).astype(np.float32)  # many ties, and vectors of zeros
    rows = spark.createDataFrame([(i, [float(p) for p in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = S.nearest(rows.where("vec_id % 10 = 0"), rows, 6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.vec_id, -9 if r.cosine is None else -round(r.cosine, 9), r.neighbour)):
        found.setdefault(r.vec_id, []).append(r.neighbour)
    length = np.linalg.norm(x.astype(float), axis=1)
    for q in range(0, 400, 10):
        with np.errstate(all="ignore"):
            c = np.round(x.astype(float) @ x[q] / (length * length[q]), 9)
        order = [i for i in np.lexsort((np.arange(400), -np.nan_to_num(c, nan=-3))) if i != q]
        assert sorted(found[q]) == sorted(order[:6])


def test_vectors_without_a_cosine_come_last(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = S.nearest(rows.where("vec_id < 3"), rows, 3).orderBy("vec_id", F.desc_nulls_last("cosine"), "neighbour")
    assert [tuple(r) for r in got.collect()] == [(1, 4, -1.0), (1, 2, None), (1, 3, None), (2, 1, None), (2, 3, None), (2, 4, None)]
