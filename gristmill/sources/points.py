"""Point files: a JSON array, or JSON lines, as rows (idx, id, vector, payload), each a VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import strip
from . import arrays

_OBJECT = "id variant, vector variant, payload variant, broken string"
_LIST = "array<struct<id:variant,vector:variant,payload:variant>>"
_MODE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "allowNonNumericNumbers": "true"}


def _rows(elements: DataFrame) -> DataFrame:
    return elements.select("idx", F.from_json("element", _OBJECT, _MODE).alias("p")).select("idx", "p.id", "p.vector", "p.payload", "p.broken")


def from_chunks(chunks: DataFrame) -> DataFrame:
    """Points of a list that was read in byte ranges."""
    listed = F.from_json("chunk", _LIST, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"})
    return arrays.elements(chunks, listed).select(F.col("pos").alias("idx"), "doc.id", "doc.vector", "doc.payload")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """A file that holds one JSON list, or else one object a line.

    Large lists (arrays.LARGE) are read by all tasks. Raises ValueError for another top-level value, a bad
    line, a line that is no object, or no point at all in lines.
    """
    if sum(arrays.sizes(spark, path).values()) >= arrays.LARGE:
        chunks = arrays.read_chunks(spark, path)
        if chunks is None:  # what is large and no list is lines
            return read_point_lines(spark, path)
        return from_chunks(chunks)
    files = spark.read.text(path, wholetext=True)
    whole = files.select(F.from_json("value", _LIST, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"}).alias("list"), F.trim(strip(F.col("value"))).alias("value"))
    looks = whole.select(F.substring("value", 1, 1).alias("lead"), F.col("list").isNotNull().alias("is_list"), F.length(F.regexp_replace("value", "[^\n]", "")).alias("breaks"), F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"}).isNotNull().alias("is_object")).collect()
    if all(x.lead == "[" and x.is_list for x in looks) and looks:
        return whole.select(F.posexplode("list").alias("idx", "p")).select(F.col("idx").cast("long").alias("idx"), "p.id", "p.vector", "p.payload")
    if len(looks) == 1 and looks[0].lead == "{" and looks[0].breaks == 0 and looks[0].is_object:
        raise ValueError("Expected a list of points at top level")
    return read_point_lines(spark, path)


def read_point_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, split over tasks; idx grows in input order."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "").select(F.monotonically_increasing_id().alias("idx"), F.col("value").alias("element"))
    rows = _rows(lines)
    bad = lines.where(~F.substring(strip(F.col("element")), 1, 1).isin("{")).limit(1).count() + rows.where("broken IS NOT NULL").limit(1).count()
    if bad:
        raise ValueError("Invalid JSON line in point file")
    if rows.limit(1).count() == 0:
        raise ValueError("No points found in file")
    return rows.drop("broken")


def from_columns(points: DataFrame) -> DataFrame:
    """Typed points (pos, id, vector, payload) as the validator reads them."""
    return points.select(F.col("pos").alias("idx"), *(F.parse_json(F.to_json(F.struct(F.col(c).alias("v")))).alias(c) for c in ("id", "vector", "payload"))).select("idx", *(F.try_variant_get(c, "$.v", "variant").alias(c) for c in ("id", "vector", "payload")))
