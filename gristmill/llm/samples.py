"""Bounded samples of rows to fit models on, chosen by a hash of the key, alike on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest text that a training sample takes; longer ones are still scored, whole.
MAX_CHARS = 200_000


def fold(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def known(docs: DataFrame, labels: DataFrame, column: str, folds: int | None = None, held: int = 0) -> DataFrame:
    """doc_id, label (0 or 1), h and bytes of every document that has a label and a text to learn from; rows of the held-out fold are left out.

    Of several labels of an id the lowest counts. Of several rows of an id one does, that of the least hash
    of its text (h). Ids and numbers are shuffled, no texts; rows of an id are reduced before that.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= MAX_CHARS))
    if folds:
        own, rows = (x.where(fold(F.col("doc_id"), folds) != held) for x in (own, rows))
    least = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes"))).alias("t"))
    return own.groupBy("doc_id").agg(F.min("label").alias("label")).join(least, "doc_id").select("doc_id", "label", "t.h", "t.bytes")


def sample(docs: DataFrame, of: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """doc_id, label and text of at most `most` documents of each label in `of` (a table of `known`), with at most so many bytes of text.

    One row of each id. What is broadcast is the ids of the sample.
    """
    picked = None
    for value in (0, 1):
        part = of.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionAll(part)
    upto = F.sum("bytes").over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = picked.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("doc_id", "label", "h")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    return texts.join(F.broadcast(picked), ["doc_id", "h"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
