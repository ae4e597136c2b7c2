"""Reference blocks: documents dealt out by id, which ask buckets of a hashed key space.

A question that concerns every document and every key (is this passage elsewhere, how often
does this word occur) is answered in three steps, each of which has bounded tasks:

1. a block of documents sends each of its distinct keys once to the bucket the key falls in;
2. a bucket merges what the blocks sent and sends each block back what concerns its keys;
3. the block reads the answers beside its documents.

A key that occurs in a third of all rows reaches a bucket once from each block, not once from
each row. Messages are packed binaries, so a key costs its own bytes and little more. A message
holds at least one key, so there are never more messages than distinct keys of blocks, however
many blocks there are: messages grow with the text. The number of blocks (and of buckets)
follows the bytes of all texts, which are summed up first, so a block has a bounded size
whatever spark.sql.shuffle.partitions says. The texts are shuffled once: every step has the
same exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a block: the first up to MOST_BLOCKS blocks, then more, up to the second.
BLOCK_BYTES, LARGEST_BLOCK, MOST_BLOCKS = 8 << 20, 256 << 20, 20_000
ASK = "block int, bucket int, body binary"
ANSWER = "block int, body binary"


def block_count(total: int, partitions: int) -> int:
    """Number of blocks, and of buckets, for so many bytes of text."""
    size = min(max(BLOCK_BYTES, -(-total // MOST_BLOCKS)), LARGEST_BLOCK)
    return max(partitions, -(-total // size))


def parts(docs: DataFrame) -> int:
    """Number of blocks for the texts of docs, one for each shuffle partition at least."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return block_count(int(total), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_block(docs: DataFrame, n: int, *keys: str) -> DataFrame:
    """Adds block; rows alike in all keys share a block, and a null key counts as a key."""
    return docs.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))


def scratch(spark: SparkSession) -> None:
    """Sets the folder for checkpoints: spark.checkpoint.dir, or one of this machine where all of Spark runs on it (tests)."""
    if spark.sparkContext.getCheckpointDir():
        return
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        own = f"{tempfile.gettempdir()}/gristmill-checkpoints"
    spark.sparkContext.setCheckpointDir(own)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    scratch(df.sparkSession)
    return df.checkpoint()


#: What may be broadcast, counted before it is: rows of a few dozen bytes.
BROADCAST_ROWS = 50_000


def join_by_hot_key(rows: DataFrame, keyed: DataFrame, on: list[str], copies: str) -> DataFrame:
    """rows joined (inner) with keyed, whose keys are unique and whose column `copies` tells how many rows have them.

    Up to BROADCAST_ROWS keys are broadcast. Of more, only those with more than one in BROADCAST_ROWS
    of all rows, which are fewer than BROADCAST_ROWS by arithmetic, so that no task gets all rows
    of a key; the others are shuffled.
    """
    many, total = keyed.agg(F.count(F.lit(1)), F.sum(copies)).first()
    if many <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed), on)
    limit = max(1000, (total or 0) // BROADCAST_ROWS)
    hot = keyed.where(F.col(copies) > limit)
    if not hot.limit(1).count():
        return rows.join(keyed, on)
    hot = F.broadcast(hot)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(keyed.where(F.col(copies) <= limit), on))


def bucket_of(key_hash: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, by its high bits."""
    return ((key_hash >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def split(key_hash: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, indices) of the hashes; indices keep their order."""
    bucket = bucket_of(key_hash, buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, order[edges[b] : edges[b + 1]]) for b in range(buckets) if edges[b + 1] > edges[b]]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as one binary."""
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(body, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def merged(bodies: list[bytes], *kinds: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The columns of several bodies one after the other, with the number of the body each row is from."""
    each = [unpack(b, *kinds) for b in bodies]
    who = np.repeat(np.arange(len(each)), [len(e[0]) for e in each])
    return who, [np.concatenate([e[i] for e in each]) if each else np.zeros(0, k) for i, k in enumerate(kinds)]


def asks(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int32()), "body": pa.array([r[2] for r in rows], pa.binary())})


def answers(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "body": pa.array([r[1] for r in rows], pa.binary())})
