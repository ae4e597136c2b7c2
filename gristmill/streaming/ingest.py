"""The same transformation over a stream of JSON lines, each id kept once.

A document has a place: its file, byte range and line. State holds, for each id, the least place
seen so far; a document passes when its place is less. So the first batch that has an id passes
it, and later ones pass it only where files come out of order, as a correction. What the sink holds in the end is
the document with the least place of each id, however the input was split into micro-batches.

The sink writes a folder for each micro-batch, named by its number, which a replay writes over: so a replay
after a failure adds nothing. `documents_of` reads the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import documents as D
from ..sources.documents import place

#: What keeps state on disk; it and the next must be set before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Bytes of a batch that a Python worker gets: whole documents pass through it, so a number of rows alone is no bound.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
LINE = "file string, start long, line long, value string"
PASSED = "id string, pos string, body string"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of each line in its byte range; a range is read by one task, in order."""
    key, n = None, 0
    for batch in batches:
        lines = []
        for own in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            key, n = own, n + 1 if own == key else 0
            lines.append(n)
        yield pa.record_batch({"file": batch.column("file"), "start": batch.column("start"), "line": pa.array(lines, pa.int64()), "value": batch.column("value")})


def read_stream(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """New files of JSON lines as they come: pos (the place, a text) and doc (VARIANT)."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    source = spark.readStream.format("text")
    if files_at_once:
        source = source.option("maxFilesPerTrigger", files_at_once)
    rows = source.load(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    lines = rows.mapInArrow(_numbered, LINE).where("trim(value) != ''")
    return lines.select(place(F.col("file"), F.col("start"), F.col("line")).alias("pos"), F.parse_json("value").alias("doc"))


class KeepFirst(StatefulProcessor):
    """Passes a row whose place is less than that of all rows of its id before it."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.least = handle.getValueState("least", "pos string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = None
        for frame in rows:
            if len(frame):
                own = frame.loc[frame["pos"].idxmin(), ["id", "pos", "body"]]
                best = own if best is None or own["pos"] < best["pos"] else best
        if best is not None and (not self.least.exists() or best["pos"] < self.least.get()[0]):
            self.least.update((best["pos"],))
            yield pd.DataFrame([best])

    def close(self) -> None:
        pass


def documents(stream: DataFrame, keep: str | None = None, mode: str = "permissive") -> DataFrame:
    """Accepted documents (id, pos, text, metadata) of a stream of pos and doc, each id once.

    keep: how long an id is remembered after it was last passed, such as '30 days'; for ever unless told.
    """
    spark = stream.sparkSession
    spark.conf.set(*STATE_STORE)
    spark.conf.set(*BATCH_BYTES)
    rows = D.accepted(D.transform(stream, mode))
    kind = rows.select(F.struct("text", "metadata").alias("b")).schema["b"].dataType
    packed = rows.select(F.col("metadata.external_id").alias("id"), "pos", F.to_json(F.struct("text", "metadata")).alias("body"))
    ms = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)
    passed = packed.groupBy("id").transformWithStateInPandas(KeepFirst(ms), PASSED, "Update", "ProcessingTime" if ms else "None")
    return passed.select("id", "pos", F.from_json("body", kind).alias("b")).select("id", "pos", "b.text", "b.metadata")


def batch_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to a folder of its own, over what an attempt before it has left."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def documents_of(spark: SparkSession, folder: str) -> DataFrame:
    """What the batches of a sink add up to: the document with the least place of each id."""
    return D.keep_first(spark.read.parquet(folder), "id", "pos").drop("batch")


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch to the sink; replays after a failure carry the same batch number."""
    return stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
