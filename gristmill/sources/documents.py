"""JSON sources as rows (pos, doc VARIANT); pos is the place in the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce as C
from . import arrays


def _keep_last_key(spark: SparkSession) -> None:
    """Of a key that an object has twice the last value counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def chosen_list(value: Column) -> Column:
    """The list itself, or an object's documents, else its results, else nothing."""
    wrapped = C.first_truthy(C.child(value, "documents"), C.child(value, "results"))
    return C.items(F.when(C.is_array(value), value).otherwise(wrapped))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON text per file. A missing path and malformed JSON fail the job.

    Lists of arrays.LARGE bytes or more, wrapped or not, are read by all tasks; what is smaller is
    parsed as a whole, a file in a task.
    """
    _keep_last_key(spark)
    if sum(arrays.sizes(spark, path).values()) >= arrays.LARGE and (found := arrays.read_array(spark, path)) is not None:
        return found
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    value = F.parse_json("value")
    scalar = F.raise_error(F.lit("the top level of the input is neither a list nor an object"))
    value_ok = files.select("file", value.alias("v")).select("file", F.when(C.is_array(F.col("v")) | C.is_object(F.col("v")), chosen_list(F.col("v"))).otherwise(scalar.cast("array<variant>")).alias("docs"))
    each = value_ok.select("file", F.posexplode("docs").alias("pos", "doc"))
    if len(spark.read.text(path).inputFiles()) > 1:  # positions go on from file to file; the driver sees one number of each
        sizes = sorted((r.file, r.n) for r in value_ok.select("file", F.coalesce(F.size("docs"), F.lit(0)).alias("n")).collect())
        before, starts = 0, []
        for file, n in sizes:
            starts.append((file, before))
            before += n
        each = each.join(F.broadcast(spark.createDataFrame(starts, "file string, before long")), "file").withColumn("pos", F.col("pos") + F.col("before"))
    return each.select(F.col("pos").cast("long").alias("pos"), "doc")


def place(file: Column, start: Column, line: Column) -> Column:
    """A text that sorts as file, byte range and line do."""
    return F.concat_ws("|", file, F.lpad(start.cast("string"), 19, "0"), F.lpad(line.cast("string"), 19, "0"))


def read_lines(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """JSON lines, split over tasks. pos is a place (file, byte range, number within it), in whatever order Spark deals out files.

    A bad line fails the job; if mode is permissive, its doc is null, and broken (file, text) tells of it.
    """
    if mode not in ("permissive", "strict"):
        raise ValueError(f"mode must be permissive or strict, not {mode!r}")
    _keep_last_key(spark)
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("start")).where(C.strip(F.col("value")) != "")
    pos = place(F.col("file"), F.col("start"), F.monotonically_increasing_id()).alias("pos")
    if mode == "strict":
        return lines.select(pos, F.parse_json("value").alias("doc"))
    doc = F.try_parse_json("value")
    return lines.select(pos, doc.alias("doc"), F.when(doc.isNull(), F.struct("file", F.col("value").alias("text"))).alias("broken"))


def head(raw: DataFrame, limit: int | None) -> DataFrame:
    """The first rows by input order. Positions of read_documents are gapless, so this is a filter."""
    if limit is None:
        return raw
    if limit < 0:
        raise ValueError("limit must not be negative")
    return raw.where(F.col("pos") < limit)


def head_of_lines(raw: DataFrame, limit: int | None) -> DataFrame:
    """The same for places."""
    if limit is None:
        return raw
    if limit < 0:
        raise ValueError("limit must not be negative")
    return raw.orderBy("pos").limit(limit)

