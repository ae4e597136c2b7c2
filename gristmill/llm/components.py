"""Connected components of a graph of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed

#: Distinct edges that one task joins by itself; with more, all tasks take part.
FEW_EDGES = 50_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every end of an edge, and the least id that it reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if (root == before).all():
            return ids, ids[root]


def _few(batches):
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if parts:
        ids, root = roots(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.record_batch({"id": ids, "component": root})


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns id, component (the least id reachable) of every id with an edge to another one.

    Up to FEW_EDGES edges, which are counted, are joined in one task. Of more, edges end as a star
    around each least id. The neighbours of an id are never gathered: its least neighbour is a
    pre-aggregated minimum, joined back to the edges. Each round is checkpointed in the shared
    folder. A null end is no edge; an empty table has no components.
    """
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = checkpointed(now)
    before = _state(now)
    if before[0] <= FEW_EDGES:
        return now.coalesce(1).mapInArrow(_few, "id long, component long")
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionAll(least.select("u", F.col("m").alias("v")))
        now = checkpointed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
