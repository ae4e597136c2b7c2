"""Vectors that are paid for once: what an embedder has answered is stored under a hash of model and text.

Texts that the store does not have are asked for, each distinct one once, in rounds. A batch that
fails does not fail its task: what the task has got by then is committed with the round, and only what
is still missing is asked for in the next one. A lost executor costs its unfinished task (TASK_TEXTS texts
at most), nothing that a round has committed. A limit on calls is shared by the tasks of a round.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MAX_CHARS, truncate_at_word
from ..sources import files
from ..sources.store import Store
from .embed import BATCH, MODEL, Embedder, embed_batches, with_retry

#: Texts that a task asks for before it commits, and texts of a round.
TASK_TEXTS, ROUND_TEXTS = 5_000, 1_000_000
KEY, TEXT = "__vector_key", "__vector_text"
ANSWER = f"{KEY} string, vector array<float>, error string"


def paced(embed: Embedder, per_minute: float | None, tasks: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Embedder:
    """Calls of a task, spaced so that `tasks` tasks at once stay within a number of calls a minute."""
    if not per_minute:
        return embed
    gap, due = 60.0 * tasks / per_minute, [clock()]

    def call(texts: list[str]) -> list[list[float]]:
        wait = due[0] - clock()
        if wait > 0:
            sleep(wait)
        due[0] = max(clock(), due[0]) + gap
        return embed(texts)

    return call


def _asking(embedder: Embedder, batch: int, per_minute: float | None, tasks: int):
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = paced(with_retry(embedder), per_minute, tasks)
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part, vectors, error = frame.iloc[lo : lo + batch], None, None
                try:
                    vectors = embed_batches(embed, part[TEXT].tolist(), batch)
                except Exception as e:  # told to the driver, which asks again or fails the run
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({KEY: part[KEY].tolist(), "vector": vectors or [None] * len(part), "error": [error] * len(part)})

    return ask


class VectorStore:
    """root: a folder that all executors share; it is made with the first vectors."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.store = spark, Store(spark, root)
        if not self.store.versions():
            schema = spark.createDataFrame([], f"{KEY} string, vector array<float>, asked timestamp").schema
            self.store.create(schema, KEY, "asked", buckets)

    def attach(self, docs: DataFrame, embedder: Embedder, model: str = MODEL, batch: int = BATCH, max_chars: int = MAX_CHARS, per_minute: float | None = None, tries: int = 3) -> DataFrame:
        """docs with a column vector; asks the embedder only for texts that the store does not have.

        Fails when `tries` rounds in a row bring nothing new; what they did bring stays in the store. A null text has a null vector.
        """
        cut = truncate_at_word(F.col("text"), max_chars)
        keyed = docs.withColumn(KEY, F.sha2(F.concat_ws("\n", F.lit(model), F.lit(str(max_chars)), cut), 256))
        keyed = keyed.withColumn(KEY, F.when(F.col("text").isNotNull(), F.col(KEY)))
        wanted = keyed.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.first(cut).alias(TEXT))
        failed = 0
        while True:
            missing = wanted.join(self.store.read().select(KEY), KEY, "left_anti").limit(ROUND_TEXTS)
            got, error = self._round(missing, embedder, batch, per_minute)
            if got == 0 and error is None:
                break
            failed = failed + 1 if not got else 0
            if failed >= tries:
                raise RuntimeError(f"{tries} rounds brought no vectors: {error}")
        return keyed.join(self.store.read().select(KEY, "vector"), KEY, "left").drop(KEY)

    def _round(self, missing: DataFrame, embedder: Embedder, batch: int, per_minute: float | None) -> tuple[int, str | None]:
        """Asks once for all of missing and stores what comes; returns how many came, and an error if some did not."""
        folder = files.scratch(self.spark, "round")
        missing.write.parquet(f"{folder}/asked")
        asked = self.spark.read.parquet(f"{folder}/asked")
        n = asked.count()
        if not n:
            return 0, None
        slots = self.spark.sparkContext.defaultParallelism
        tasks = max(min(slots, -(-n // batch)), -(-n // TASK_TEXTS))
        answers = asked.repartition(tasks, KEY).mapInPandas(_asking(embedder, batch, per_minute, min(slots, tasks)), ANSWER)
        answers.write.parquet(f"{folder}/answered")
        answers = self.spark.read.parquet(f"{folder}/answered")
        came, error = answers.agg(F.count("vector"), F.max("error")).first()
        if came:
            self.store.merge(answers.where("vector IS NOT NULL").select(KEY, "vector", F.current_timestamp().alias("asked")))
        fs, own = files.at(self.spark, folder)
        fs.delete(own, True)
        return came, error
