"""Indexed nearest neighbours: coarse cells by k-means, the nearest cells probed, exact cosines within them.

The centres are fitted on a bounded sample of vectors (SAMPLE, by hash of the key) in numpy; every vector is
assigned to its nearest centre by the tasks that read it, and written by cell. A query goes to its nearest cells; how
many of them is measured: of TUNING queries, at most, every true neighbour is looked up, and as many cells are
probed as find the asked share of them. Conditions on payload columns are applied to the vectors before they
meet queries, so a search never returns fewer rows because of what it would have filtered afterwards.

Vectors meet queries by cell in a shuffle. Large cells are cut into slices of SLICE vectors and many
queries into blocks of QUERIES, so that a task multiplies two bounded matrices at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import SCORES, best

#: Vectors that centres are fitted on, most cells, rounds of k-means.
SAMPLE, CELLS, ROUNDS = 20_000, 4_096, 12
#: Vectors of a slice, queries of a block, and queries that the number of probes is measured on.
SLICE, QUERIES, TUNING = 8_192, 4_096, 200
#: Rows of a batch of vectors with their cells.
OUT = 1 << 14


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def centres(vectors: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Unit centres of n cells by spherical k-means; empty cells take the vectors that fit worst."""
    rng = np.random.default_rng(seed)
    own = vectors[rng.permutation(len(vectors))[:n]]
    step = max(1, SCORES // max(1, n))
    for _ in range(ROUNDS):
        cell, fit = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        for lo in range(0, len(vectors), step):
            part = vectors[lo : lo + step] @ own.T
            cell[lo : lo + step], fit[lo : lo + step] = part.argmax(axis=1), part.max(axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, cell, vectors)
        empty = np.flatnonzero(np.bincount(cell, minlength=n) == 0)
        sums[empty] = vectors[np.argsort(fit, kind="stable")[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        own = np.divide(sums, length, out=own.copy(), where=length > 0)
    return own


def _assigning(own: np.ndarray, probes: int):
    """Rows with the cells nearest to their vector (column v), nearest first, and the rank of each; so many at a time as make OUT rows."""
    step = max(1, min(SCORES // max(1, len(own)), OUT // probes))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                fit = _matrix(batch.column("v")) @ own.T if own.size else np.zeros((batch.num_rows, 1))
                order = fit.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-fit, axis=1, kind="stable")[:, :probes]
                rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), order.shape[1])))
                cells, ranks = pa.array(order.ravel(), pa.int32()), pa.array(np.tile(np.arange(order.shape[1]), batch.num_rows), pa.int32())
                yield pa.RecordBatch.from_arrays([*rows.columns, cells, ranks], names=[*rows.schema.names, "cell", "cell_rank"])

    return assign


def _scoring(k: int):
    """The k best vectors of a slice for each query of a block."""

    def score(_, asked: pa.Table, held: pa.Table) -> pa.Table:
        names = {"q": pa.int64(), "neighbour": pa.int64(), "cosine": pa.float64(), "cell_rank": pa.int32()}
        if not len(asked) or not len(held):
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        q, keys = asked.column("q").to_numpy(), held.column("key").to_numpy()
        found = best(q, _matrix(asked.column("v").combine_chunks()), keys, _matrix(held.column("v").combine_chunks()), k, 12)
        row, at, _, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
        out = {"q": q[row], "neighbour": keys[at], "cosine": cosine, "cell_rank": asked.column("cell_rank").to_numpy()[row]}
        return pa.table({n: pa.array(x, names[n]) for n, x in out.items()})

    return score


@dataclass(frozen=True)
class VectorIndex:
    folder: str
    centres: np.ndarray
    slices: dict[int, int]
    probes: int

    def rows(self, spark) -> DataFrame:
        """key, v, cell and the payload columns of all vectors."""
        return spark.read.parquet(self.folder)

    def search(self, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """q, neighbour and cosine of the k nearest other vectors of each query (q, v), of those that meet a condition on the payload.

        Ties go to the lesser key. Queries without a vector have no rows.
        """
        found = self._scored(queries, k, where, probes or self.probes)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "neighbour"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "neighbour", "cosine")

    def _scored(self, queries: DataFrame, k: int, where: Column | None, probes: int) -> DataFrame:
        spark = queries.sparkSession
        queries = queries.select(F.col("q").cast("long").alias("q"), F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL")
        blocks = max(1, -(-queries.count() // QUERIES))
        asked = queries.mapInArrow(_assigning(self.centres, min(probes, len(self.centres))), "q long, v array<double>, cell int, cell_rank int")
        cut = F.create_map(*(F.lit(x) for c, n in self.slices.items() if n > 1 for x in (c, n))) if max(self.slices.values(), default=1) > 1 else None
        n = F.coalesce(F.try_element_at(cut, F.col("cell")), F.lit(1)) if cut is not None else F.lit(1)
        asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
        held = self.rows(spark) if where is None else self.rows(spark).where(where)
        held = held.select("key", "v", "cell").withColumn("slice", F.pmod(F.xxhash64("key"), n).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        by = ("cell", "slice", "block")
        return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(_scoring(k), "q long, neighbour long, cosine double, cell_rank int")


def build(vectors: DataFrame, folder: str, key: str, column: str, payload: tuple[str, ...] = (), cells: int | None = None, recall: float = 0.9, k: int = 10) -> VectorIndex:
    """An index of all vectors in a folder that executors share, tuned to find `recall` of the k nearest.

    Rows without a key or a vector are left out. There must be none but vectors of one length.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("v"), *payload)
    n = rows.count()
    sample = _matrix(rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks())
    own = centres(sample, max(1, min(cells or round(n**0.5), CELLS, len(sample)))) if len(sample) else np.zeros((1, 0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    assigned = rows.mapInArrow(_assigning(own, 1), f"{schema}, cell int, cell_rank int").drop("cell_rank")
    salts = max(16, n // 1_000_000)  # a cell may hold a third of all vectors
    assigned.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(salts))).sortWithinPartitions("cell").write.mode("overwrite").parquet(folder)
    sizes = {r.cell: r["count"] for r in spark.read.parquet(folder).groupBy("cell").count().collect()}
    index = VectorIndex(folder, own, {c: -(-m // SLICE) for c, m in sizes.items()}, len(own))
    some = rows.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(TUNING).select(F.col("key").alias("q"), "v")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "neighbour"))
    true = index._scored(some, k, None, len(own)).withColumn("rank", rank).where(F.col("rank") <= k)
    hits = {r.cell_rank: r["count"] for r in true.groupBy("cell_rank").count().collect()}
    found, total, probes = 0, sum(hits.values()), len(own)
    for p in range(len(own)):
        found += hits.get(p, 0)
        if found >= min(1.0, recall + 0.02) * total:  # a little more than asked, as this is a sample
            probes = p + 1
            break
    return VectorIndex(folder, own, index.slices, probes)
