"""Sinks: partitioned JSON lines, single-file JSON arrays for compatibility, run metadata, retention."""

from __future__ import annotations

import json
import logging
import re
import uuid
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import files

log = logging.getLogger(__name__)
#: Names of the files a run writes (the last is our own).
DOCUMENTS, POINTS, METADATA, REJECTS = "transformed", "qdrant_points", "run_metadata", "rejected"
#: What stands between the elements of an exported array.
SEPARATOR = ",\n"


def run_stamp(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


def file_name(kind: str, stamp: str, keep_history: bool) -> str:
    return f"{kind}_{stamp}.json" if keep_history else f"{kind}.json"


def write_lines(rows: DataFrame, folder: str) -> None:
    """The native sink: JSON lines in parallel; the committer leaves no partial output."""
    rows.write.mode("overwrite").json(folder)


def _indented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compact JSON objects as the indented elements of an array."""
    for batch in batches:
        rows = (json.dumps(json.loads(row), ensure_ascii=False, indent=2) for row in batch.column("row").to_pylist())
        yield pa.record_batch({"value": pa.array(["  " + r.replace("\n", "\n  ") for r in rows], pa.string())})


def export_array(rows: DataFrame, path: str | Path, order: str = "pos") -> int:
    """One indented JSON array in input order; returns the number of rows.

    Absent strings are left out, empty lists stay. Tasks format and write the rows, dealt by ranges of
    the order, to a folder beside the file, which Spark commits; the JVM then joins its files, as bytes,
    and renames the whole. The file appears only when it is complete, and nothing else stays. The
    folder is on the file system of the path, which must be shared on a cluster.
    """
    spark = rows.sparkSession
    fs, target = files.at(spark, str(path))
    own = files.child(spark, target.getParent(), f".{target.getName()}-{uuid.uuid4()}")
    parts, joined = files.child(spark, own, "parts"), files.child(spark, own, "joined")
    count = Observation()
    texts = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).observe(count, F.count(F.lit(1)).alias("n"))
    texts = texts.select(F.to_json(F.struct(*(c for c in rows.columns if c != order))).alias("row")).mapInArrow(_indented, "value string")
    try:
        texts.write.option("lineSep", SEPARATOR).text(parts.toString())
        found = [f for f in files.listed(fs, parts) if f.getPath().getName().startswith("part-") and f.getLen()]
        found.sort(key=lambda f: int(f.getPath().getName().split("-")[1]))
        files.join(spark, fs, joined, "[\n" if found else "[", found, len(SEPARATOR), "\n]" if found else "]")
        files.replace(spark, fs, joined, target)
    finally:
        fs.delete(own, True)
    return count.get["n"]


def save_metadata(spark: SparkSession, folder: str | Path, stamp: str, keep_history: bool, facts: dict) -> None:
    """One JSON file on any file system; best effort: a failure is logged and does not fail the run."""
    try:
        files.write_text(spark, f"{folder}/{file_name(METADATA, stamp, keep_history)}", json.dumps(facts | {"timestamp": stamp}, ensure_ascii=False, indent=2))
    except Exception:
        log.warning("run metadata could not be saved", exc_info=True)


def clean_up(spark: SparkSession, folder: str | Path, keep_last: int = 10) -> list[str]:
    """Deletes the files (or folders, of native runs) of runs beyond the newest keep_last of each kind; returns their names.

    Works on any file system that Spark writes to; only names and times are listed.
    """
    if keep_last < 0:
        raise ValueError("keep_last must not be negative")
    fs, top = files.at(spark, str(folder))
    gone: list[str] = []
    for kind in (DOCUMENTS, POINTS, METADATA, REJECTS):
        runs = [f for f in files.listed(fs, top) if re.fullmatch(rf"{kind}_[0-9]\w*(\.json)?", f.getPath().getName())]
        runs.sort(key=lambda f: (f.getModificationTime(), f.getPath().getName()), reverse=True)
        for f in runs[keep_last:]:
            fs.delete(f.getPath(), True)
            gone.append(f.getPath().getName())
    return gone
