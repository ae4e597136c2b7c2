"""Coercions of loosely typed JSON (VARIANT) to strings and lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point that Unicode counts as white space.
WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: JSON spellings of what counts as false.
FALSY = ("null", '""', "0", "0.0", "false", "[]", "{}")


def child(v: Column, path: str) -> Column:
    """The value at a path such as a.b; null where a parent is missing or no object."""
    return F.try_variant_get(v, "$." + path, "variant")


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(WS))


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_array(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("ARRAY"), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def is_string(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def truthy(v: Column) -> Column:
    """False for missing, null, empty and zero values; a blank string is true."""
    return ~F.coalesce(F.to_json(v).isin(*FALSY), F.lit(True))


def first_truthy(*values: Column) -> Column:
    """The first true value, or else the last one, whatever it is."""
    return F.coalesce(F.get(F.filter(F.array(*values[:-1]), truthy), 0), values[-1])


def to_str(v: Column) -> Column:
    """A scalar as text; booleans are spelled True and False, objects and lists as JSON."""
    return let(v, lambda x: F.when(kind(x) == "BOOLEAN", F.initcap(F.try_variant_get(x, "$", "string"))).otherwise(F.try_variant_get(x, "$", "string")))


def blank_to_null(s: Column) -> Column:
    return let(strip(s), lambda x: F.when(x != "", x))


def opt_str(v: Column) -> Column:
    return blank_to_null(to_str(v))


def iso(s: Column) -> Column:
    """Drops zero milliseconds: text that ends with .000Z has every .000Z replaced by Z."""
    return let(s, lambda x: F.when(F.endswith(x, F.lit(".000Z")), F.replace(x, F.lit(".000Z"), F.lit("Z"))).otherwise(x))


def opt_iso(v: Column) -> Column:
    return iso(opt_str(v))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def items(v: Column) -> Column:
    """The elements of a list; an empty array for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def present(strings: Column) -> Column:
    return F.filter(strings, lambda s: s.isNotNull())


def str_list(v: Column) -> Column:
    """A list's non-blank elements as text; a scalar becomes a list of one."""
    return let(v, lambda x: F.when(~truthy(x), no_strings()).when(is_array(x), present(F.transform(items(x), opt_str))).otherwise(present(F.array(opt_str(x)))))


def merge_list(primary: Column, direct: Column) -> Column:
    """primary as it is, then what direct has beyond it, each once."""
    return let(primary, lambda own: F.concat(own, F.array_except(direct, own)))
