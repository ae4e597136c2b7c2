"""Text cleaning and truncation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import strip

#: Fixed values.
TAG, LINK, SPACES, RULE, NEWLINES = r"<[^>]+>", r"\[([^\]]+)\]\([^\)]+\)", r" {2,}", r"(?md)^[*-]{3,}$", r"\n{3,}"
SEPARATOR, MAX_CHARS, BACK_OFF = "\n\n", 8000, 0.8


def strip_tags(s: Column) -> Column:
    return F.regexp_replace(s, TAG, "")


def markdown_links(s: Column) -> Column:
    return F.regexp_replace(s, LINK, "$1")


def collapse_spaces(s: Column) -> Column:
    return F.regexp_replace(s, SPACES, " ")


def drop_rules(s: Column) -> Column:
    return F.regexp_replace(s, RULE, "")


def cap_newlines(s: Column) -> Column:
    return F.regexp_replace(s, NEWLINES, SEPARATOR)


def clean_fragment(unescaped: Column) -> Column:
    """A fragment whose entities are decoded already; null becomes empty."""
    return strip(collapse_spaces(markdown_links(strip_tags(F.coalesce(unescaped, F.lit(""))))))


def normalize(s: Column) -> Column:
    return strip(cap_newlines(drop_rules(s)))


def assemble(unescaped: Column) -> Column:
    """One text from an array of decoded fragments, in order, empty ones dropped."""
    kept = F.filter(F.transform(unescaped, clean_fragment), lambda s: s != "")
    return normalize(F.array_join(kept, SEPARATOR))


def truncate_head(s: Column, most: int = MAX_CHARS) -> Column:
    return F.substring(s, 1, most)


def truncate_at_word(s: Column, most: int = MAX_CHARS) -> Column:
    """At most so many characters, cut at the last space if that keeps over four fifths of them."""
    head = F.substring(s, 1, most)
    back = F.instr(F.reverse(head), " ")
    space = F.length(head) - back
    return F.when(F.length(s) <= most, s).when((back > 0) & (space > int(most * BACK_OFF)), F.left(head, space)).otherwise(head)
