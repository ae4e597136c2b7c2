"""HTML entity decoding as column expressions: named references with longest-prefix match, and numbers with their fix-ups.

The table of names is the HTML5 one that Python ships; it enters a plan as one folded literal, a
map for each first character, so that a lookup compares a few dozen names.
"""

from __future__ import annotations

import html.entities
import json
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import let

#: Fixed value: what may be a reference (HTML5).
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Fixed value: stands for what is no character.
REPLACEMENT = "\ufffd"


@cache
def _names(only: tuple[str, ...] | None) -> str:
    """{first character: {name without it: text}} as JSON, of all names or of some."""
    out: dict[str, dict[str, str]] = {}
    for name in html.entities.html5 if only is None else only:
        out.setdefault(name[0], {})[name[1:]] = html.entities.html5[name]
    return json.dumps(out)


@cache
def _longest() -> int:
    return max(map(len, html.entities.html5))


@cache
def _fixed() -> str:
    """{number: text} of the numbers that HTML5 replaces: nothing, and those that mean Windows-1252."""
    out = {0: REPLACEMENT, 0x0D: "\r"}
    for n in range(0x80, 0xA0):
        try:
            out[n] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            out[n] = chr(n)
    return json.dumps(out)


def _number(digits: Column, base: int) -> Column:
    """The text of a numeric reference; too many digits are no character."""
    short = F.regexp_replace(digits, "^0+", "")
    value = F.when(F.length(short) > 8, F.lit(1 << 40)).otherwise(F.conv(F.concat(F.lit("0"), short), base, 10).cast("long"))

    def decoded(n: Column) -> Column:
        fixed = F.try_element_at(F.from_json(F.lit(_fixed()), "map<string,string>"), n.cast("string"))
        dropped = n.between(0x1, 0x8) | (n == 0xB) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
        text = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(fixed.isNotNull(), fixed).when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), REPLACEMENT).when(dropped, "").otherwise(text)

    return let(value, decoded)


def _named(name: Column, only: tuple[str, ...] | None) -> Column:
    """The longest name of the table that name begins with, decoded, and what follows it; what has none stays."""

    def found(own: Column) -> Column:
        sizes = F.sequence(F.least(F.length(name), F.lit(_longest())), F.lit(2), F.lit(-1))
        hit = F.get(F.filter(F.transform(sizes, lambda n: F.struct(n.alias("n"), F.try_element_at(own, F.substr(name, F.lit(2), n - 1)).alias("t"))), lambda h: h.t.isNotNull()), 0)
        return let(hit, lambda h: F.when(h.isNull(), F.concat(F.lit("&"), name)).otherwise(F.concat(h.t, F.substr(name, h.n + 1))))

    inner = F.try_element_at(F.from_json(F.lit(_names(only)), "map<string,map<string,string>>"), F.left(name, F.lit(1)))
    return F.when(F.length(name) < 2, F.concat(F.lit("&"), name)).otherwise(let(inner, lambda own: F.when(own.isNull(), F.concat(F.lit("&"), name)).otherwise(found(own))))


def _decoded(reference: Column, only: tuple[str, ...] | None) -> Column:
    name = F.substr(reference, F.lit(2))
    number = F.regexp_replace(F.substr(reference, F.lit(3)), "^[xX]|;$", "")
    hexadecimal = F.lower(F.substr(reference, F.lit(3), F.lit(1))) == "x"
    numbered = F.when(hexadecimal, _number(number, 16)).otherwise(_number(number, 10)) if only is None else reference
    return F.when(F.startswith(name, F.lit("#")), numbered).otherwise(_named(name, only))


def _all(s: Column, only: tuple[str, ...] | None) -> Column:
    """The text between references, and the references decoded, in turn."""
    between = F.split(s, REFERENCE, -1)
    references = F.concat(F.transform(F.regexp_extract_all(s, F.lit(REFERENCE), F.lit(0)), lambda r: _decoded(r, only)), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, references, lambda a, b: F.concat(a, b)), "")


def unescape(s: Column, only: tuple[str, ...] | None = None) -> Column:
    """Only texts with an ampersand are taken apart.

    All references are decoded, or those names alone that only lists as HTML5 spells them: copy; needs its semicolon,
    copy does not.
    """
    return F.when(F.contains(s, F.lit("&")), _all(s, only)).otherwise(s)


def unescape_all(strings: Column) -> Column:
    return F.transform(strings, lambda s: unescape(s))
