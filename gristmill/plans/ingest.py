"""The ingestion run: read, transform, keep the first of each id, embed, write.

What the transformation makes of the input, rejected rows included, is written once, as a table of
its own beside the outputs. Counts, documents, points and rejects are taken from that table, so
the input is read and parsed once, counts are exact whatever tasks are repeated, and a lost
executor costs no second parsing. The table goes when the run ends.
"""

from __future__ import annotations

import logging
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators.embed import BATCH, Embedder, Settings, attach_vectors, checked
from ..operators.vector_store import VectorStore
from ..sources import files, sinks
from ..sources.documents import head, head_of_lines, read_documents, read_lines

log = logging.getLogger(__name__)
#: Why a line that is no JSON is rejected.
MALFORMED = "malformed"


def prepare(raw: DataFrame, mode: str = "permissive") -> DataFrame:
    """Documents ready to be embedded or written: pos, text, metadata."""
    return D.keep_first(D.accepted(D.transform(raw, mode)))


def staged(raw: DataFrame, folder: str, mode: str = "permissive") -> DataFrame:
    """The transformed rows of raw, written to folder and read again. A row of raw that is no JSON (broken) is rejected."""
    rows = D.transform(raw, mode, keep=("broken",) if "broken" in raw.columns else ())
    if "broken" in raw.columns:
        rows = rows.withColumn("reject_reason", F.when(F.col("broken").isNotNull(), MALFORMED).otherwise(F.col("reject_reason")))
    rows.write.parquet(folder)
    return raw.sparkSession.read.parquet(folder)


def check_broken(rows: DataFrame, most: float) -> int:
    """The number of rows that were no JSON; fails if they are more than a share of all."""
    total, n = rows.agg(F.count(F.lit(1)), F.count_if(F.col("reject_reason") == MALFORMED)).first()
    if n > most * total:
        raise ValueError(f"{n} of {total} lines are malformed JSON, more than a share of {most}")
    return n


def run_pipeline(
    spark: SparkSession,
    input_path: str,
    output_dir: str,
    limit: int | None = None,
    dry_run: bool = False,
    skip_embeddings: bool = False,
    keep_history: bool = True,
    batch_size: int = BATCH,
    embedder: Embedder | None = None,
    mode: str = "permissive",
    native: bool = False,
    lines: bool = False,
    rejects: bool = False,
    most_broken: float = 0.0,
    vector_store: str | None = None,
) -> tuple[int, int, dict[str, str]]:
    """(total read, processed, paths written).

    lines reads JSON lines, split over tasks, of which a share of most_broken may be malformed in
    permissive mode; native writes folders of JSON lines instead of single files; rejects writes the
    rejected rows with their reasons too; vector_store is a folder that keeps vectors, so that none is asked
    for twice, whatever runs again. Without an embedder the environment tells which; a run that
    embeds fails at once if it names none.
    """
    if embedder is None and not dry_run and not skip_embeddings:
        embedder = Settings.read().embedder()
    began, stamp = time.time(), sinks.run_stamp()
    fs, out = files.at(spark, output_dir)
    fs.mkdirs(out)
    work = files.child(spark, out, f".run-{uuid.uuid4()}")
    try:
        raw = read_lines(spark, input_path, mode) if lines else read_documents(spark, input_path)
        rows = staged((head_of_lines if lines else head)(raw, limit), work.toString(), mode)
        counts = D.counters(rows).first()
        total = counts.total if limit is None else raw.count()
        log.info("of %d raw documents kept %d, skipped %d, duplicates %d", total, counts.kept, counts.skipped, counts.duplicates)
        if lines:
            check_broken(rows, most_broken)
        docs = D.keep_first(D.accepted(rows))
        paths: dict[str, str] = {}
        if dry_run:
            return total, counts.kept, paths

        def write(name: str, kind: str, frame: DataFrame) -> None:
            target = f"{output_dir}/{kind}_{stamp}" if native else f"{output_dir}/{sinks.file_name(kind, stamp, keep_history)}"
            sinks.write_lines(frame, target) if native else sinks.export_array(frame, target)
            paths[name] = target

        write("transformed", sinks.DOCUMENTS, docs)
        if rejects:
            write("rejected", sinks.REJECTS, rows.where("reject_reason IS NOT NULL").select("pos", F.col("pos").alias("place"), *(c for c in ("reject_reason", "shape_warnings", "text", "metadata", "broken") if c in rows.columns)))
        if not skip_embeddings:
            pointed = VectorStore(spark, vector_store).attach(docs, embedder, batch=batch_size) if vector_store else attach_vectors(docs, embedder, batch_size)
            pointed = pointed.persist()
            try:
                write("points", sinks.POINTS, D.points(checked(pointed), F.col("vector")))
            finally:
                pointed.unpersist()
        if keep_history:
            facts = {"timestamp": stamp, "input_file": input_path, "total_raw": total, "processed": counts.kept, "skipped": counts.skipped, "duplicates_removed": counts.duplicates, "embeddings_generated": not skip_embeddings, "outputs": paths, "duration_seconds": time.time() - began}
            sinks.save_metadata(spark, output_dir, stamp, keep_history, facts)
        return total, counts.kept, paths
    finally:
        fs.delete(work, True)
