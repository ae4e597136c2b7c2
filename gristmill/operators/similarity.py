"""Nearest vectors by cosine similarity for a stated set of queries.

Every query is scored against every vector, so the work grows with the product of both. Vectors meet queries
in slices and blocks of bounded size, each of which is a product of two matrices in a task; what leaves a
task is the k best of a slice for each query of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Vectors of a slice, at most about so many, queries of a block, and the least number of slices, so that all tasks have work.
SLICE, BLOCK, SLICES = 8_192, 4_096, 16
#: Scores that a task holds at a time.
SCORES = 1 << 21
#: Cosines are held against each other in so many digits; less than any cosine is that of a vector without one.
DIGITS, NONE = 9, -3.0


def unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length; of zeros for a vector that is null, has a null in it or has no length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    own = flat.reshape(int(there.sum()), -1) if there.any() else np.zeros((0, 1))
    length = np.linalg.norm(own, axis=1, keepdims=True)
    rows = np.zeros((len(column), own.shape[1]))
    rows[there] = np.divide(own, length, out=np.zeros_like(own), where=length > 0)
    return rows


def best(q: np.ndarray, asked: np.ndarray, keys: np.ndarray, held: np.ndarray, k: int, digits: int, none: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query's row, vector's row, cosine, cosine in so many digits) of the k best other vectors of each query, best first, so many scores at a time.

    Ties go to the lesser key. With none, that is the cosine with a vector of zeros; otherwise 0 is.
    """
    blank = None if none is None else (~asked.any(axis=1), ~held.any(axis=1))
    step = max(1, SCORES // max(1, len(keys)))
    for lo in range(0, len(q), step):
        part = slice(lo, lo + step)
        score = asked[part] @ held.T
        if blank:
            score[blank[0][part]] = none
            score[:, blank[1]] = none
        score[q[part, None] == keys[None, :]] = -np.inf  # not itself
        # what may be among the k best once it is rounded is sorted, nothing else
        least = np.partition(score, len(keys) - k, axis=1)[:, len(keys) - k] - 2 * 10.0**-digits if k < len(keys) else np.full(len(score), -np.inf)
        row, at = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        cosine = score[row, at]
        near = np.round(cosine, digits)
        order = np.lexsort((keys[at], -near, row))
        row, at, cosine, near = row[order], at[order], cosine[order], near[order]
        first = np.searchsorted(row, row)
        top = np.arange(len(row)) - first < k
        yield row[top] + lo, at[top], cosine[top], near[top]


def _scoring(k: int, key: str, kind: pa.DataType):
    """The k best vectors of a slice for each query of a block."""
    schema = pa.schema([(key, kind), ("neighbour", kind), ("cosine", pa.float64()), ("near", pa.float64())])

    def score(_, asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return schema.empty_table()
        q, keys = (t.column(c).to_numpy() for t, c in ((asked, "q"), (held, "neighbour")))
        own, others = unit(asked.column("v")), unit(held.column("v"))
        if not own.any() or not others.any():  # of nulls alone the length is not known
            own, others = np.zeros((len(q), 1)), np.zeros((len(keys), 1))
        found = best(q, own, keys, others, k, DIGITS, NONE)
        row, at, cosine, near = (np.concatenate(x) for x in zip(*found, strict=True))
        values = [pa.array(q[row], kind), pa.array(keys[at], kind), pa.array(cosine, mask=near == NONE), pa.array(near)]
        return pa.Table.from_arrays(values, schema=schema)

    return score


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, neighbour and cosine of the k nearest other vectors of each query; ties go to the lesser key.

    Vectors, all of one length, are dealt out over slices, queries over blocks, by hash. A vector that is null
    or has no length has no cosine (null) and comes last; rows without a key are left out.
    """
    numbers = F.col(column).cast("array<double>").alias("v")
    asked = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("q"), numbers)
    held = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("neighbour"), numbers)
    slices, blocks = max(SLICES, -(-held.count() // SLICE)), max(1, -(-asked.count() // BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("slice", every(slices))
    held = held.withColumn("slice", F.pmod(F.xxhash64("neighbour"), F.lit(slices)).cast("int")).withColumn("block", every(blocks))
    kind = vectors.schema[key].dataType
    by = ("slice", "block")
    scored = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(_scoring(k, key, to_arrow_type(kind)), f"`{key}` {kind.simpleString()}, neighbour {kind.simpleString()}, cosine double, near double")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("near"), "neighbour"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "neighbour", "cosine")
