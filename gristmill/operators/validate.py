"""Validator of points: a list of errors and one of warnings for each, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as C

#: Fields whose absence is worth a warning, in order.
EXPECTED = ("title", "url", "external_id")


def _missing(v: Column) -> Column:
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def type_name(v: Column) -> Column:
    """Names of JSON types as messages spell them."""
    k = C.kind(v)
    return F.when(v.isNull() | (k == "VOID"), "NoneType").when(k == "STRING", "str").when(k == "BOOLEAN", "bool").when(k == "BIGINT", "int").when(k.startswith("ARRAY"), "list").when(k.startswith("OBJECT"), "dict").otherwise("float")


def is_finite_number(v: Column) -> Column:
    """Numbers other than NaN and the infinities; booleans pass."""
    k = C.kind(v)
    number = (k == "BIGINT") | (k == "BOOLEAN") | (k == "DOUBLE") | (k == "FLOAT") | k.startswith("DECIMAL")
    d = F.try_variant_get(v, "$", "double")
    return F.coalesce(number & d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), F.lit(False))


def _spelled(v: Column) -> Column:
    k, s = C.kind(v), C.to_str(v)
    text = F.when(k == "STRING", F.concat(F.lit("'"), s, F.lit("'"))).when(_missing(v), F.lit("None"))
    d = F.try_variant_get(v, "$", "double")
    return text.when((k == "DOUBLE") & F.isnan(d), "nan").when((k == "DOUBLE") & (d == float("inf")), "inf").when((k == "DOUBLE") & (d == float("-inf")), "-inf").otherwise(s)


def findings(idx: Column, id_: Column, vector: Column, payload: Column, expected_dim: int | None = None) -> tuple[Column, Column]:
    """(errors, warnings) of a point; a payload that is missing or no object ends the checks."""
    say = lambda *parts: F.concat(F.lit("[idx="), idx.cast("string"), F.lit("] "), *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    elements = C.items(vector)
    bad_at = F.array_position(F.transform(elements, lambda v: ~is_finite_number(v)), True)
    text = C.child(payload, "text")
    has_object = C.is_object(payload)
    fields = F.map_keys(F.try_variant_get(payload, "$", "map<string,variant>"))
    nested = F.array_contains(fields, "metadata")
    meta = C.child(payload, "metadata")
    meta_ok = has_object & (~nested | C.is_object(meta))
    meta_fields = F.when(nested, F.map_keys(F.try_variant_get(meta, "$", "map<string,variant>"))).otherwise(F.filter(fields, lambda k: ~k.isin("text", "metadata")))
    url = F.when(nested, C.child(meta, "url")).otherwise(C.child(payload, "url"))
    errors = [
        F.when(_missing(id_), say("missing 'id'")).when(~C.kind(id_).isin("STRING", "BIGINT", "BOOLEAN"), say("'id' should be str or int, got ", type_name(id_))),
        F.when(_missing(vector), say("missing 'vector'")).when(~C.is_array(vector), say("'vector' should be a list, got ", type_name(vector))),
        F.when(C.is_array(vector) & (F.size(elements) != expected_dim), say("vector length ", F.size(elements).cast("string"), f" != expected_dim {expected_dim}")) if expected_dim is not None else F.lit(None).cast("string"),
        F.when(C.is_array(vector) & (bad_at > 0), say("vector[", (bad_at - 1).cast("string"), "] is not a finite number (got ", _spelled(F.get(elements, (bad_at - 1).cast("int"))), ")")),
        F.when(_missing(payload), say("missing 'payload'")).when(~has_object, say("'payload' should be an object, got ", type_name(payload))),
        F.when(has_object & _missing(text), say("payload missing required 'text' field")).when(has_object & ~C.is_string(text), say("payload.text should be a string, got ", type_name(text))),
        F.when(has_object & ~meta_ok, say("payload.metadata exists but is not a dict (got ", type_name(meta), ")")),
        F.when(has_object & ~meta_ok, say("could not determine metadata dict")),
    ]
    warnings = [
        F.when(has_object & C.is_string(text) & (C.strip(C.to_str(text)) == ""), say("payload.text is empty/whitespace")),
        *(F.when(meta_ok & ~F.array_contains(meta_fields, key), say(f"metadata missing expected field '{key}'")) for key in EXPECTED),
        F.when(meta_ok & ~_missing(url) & ~C.is_string(url), say("metadata.url is not a string (got ", type_name(url), ")")),
    ]
    return C.present(F.array(*errors)), C.present(F.array(*warnings))


def validate(points: DataFrame, expected_dim: int | None = None) -> DataFrame:
    """points: idx, id, vector, payload (VARIANT). Adds errors and warnings."""
    errors, warnings = findings(F.col("idx"), F.col("id"), F.col("vector"), F.col("payload"), expected_dim)
    return points.withColumns({"errors": errors, "warnings": warnings})


def summary(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"))


def report(validated: DataFrame, level: str) -> DataFrame:
    """idx, place and message of every finding of a level (errors or warnings)."""
    return validated.select("idx", F.posexplode(level).alias("place", "message"))
