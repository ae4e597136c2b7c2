"""Corpus pipeline: each stage reads what its predecessor kept.

Toxic documents go, one document of each near-duplicate group stays, documents that hold a
benchmark item go, secrets are masked, and what is left is packed into sequences. All stages
but the last return the columns of documents, whatever their names. Stages that drop rows keep
those they cannot judge (null or empty texts). Rows without a doc_id, or with a repeated one, are
judged by their own texts; of rows equal in doc_id and text one stays. An empty table gives an
empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.blocks import scratch
from gristmill.llm.decontaminate import clean_documents
from gristmill.llm.packing import pack
from gristmill.llm.secrets import redact
from gristmill.llm.toxicity import keep_clean
from gristmill.llm.trie_join import one_of_each


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("toxicity", toxicity),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Two stages are trained models, which SQL cannot express; the tests hold the stages against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again.

    A stage's input is deleted when its output is written; that of the last one, which the result reads, stays.
    """
    scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
            if before:
                _delete(spark, before)
            before = f"{folder}/{number}-{name}"
    return docs
