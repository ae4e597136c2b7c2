"""Text rules against a restatement with Python's re and html."""

import html
import random
import re

from gristmill.functions import text as X
from gristmill.functions.coerce import WS, iso, strip
from gristmill.functions.entities import unescape, unescape_all
from pyspark.sql import functions as F


def clean(s):
    s = re.sub(r"<[^>]+>", "", html.unescape(s))
    return re.sub(" {2,}", " ", re.sub(r"\[([^\]]+)\]\([^\)]+\)", r"\1", s)).strip()


def whole(fragments):
    s = "\n\n".join(x for x in map(clean, fragments) if x)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"^[\*\-]{3,}$", "", s, flags=re.M)).strip()


def test_white_space_is_unicode_white_space():
    assert sorted(WS) == [chr(i) for i in range(0x110000) if chr(i).isspace()]


def test_assembly_equals_restatement(spark):
    rng = random.Random(0)
    parts = ["a", "B", " ", "  ", "\n", "\r\n", "\n\n\n", "***", "---", "<b>", "</b>", "<", ">", "&amp;", "&lt;i&gt;", "&amp", "&#65;", "[x](y)", "[a[b](c)", "![i](u)", "\xa0", " ", "\u0085", "\U0001f600", "\t"]
    rows = [(i, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 4))]) for i in range(2000)]
    got = spark.createDataFrame(rows, "i int, f array<string>").select("i", X.assemble(unescape_all(F.col("f"))).alias("t")).collect()
    for r in got:
        assert r.t == whole(rows[r.i][1]), rows[r.i]


def test_unescape_keeps_nulls(spark):
    got = spark.createDataFrame([(0, None), (1, "a&lt;b"), (2, "plain")], "i int, s string").select("i", unescape(F.col("s")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [None, "a<b", "plain"]


def test_truncation(spark):
    def cut(t, n=100):
        if len(t) <= n:
            return t
        h = t[:n]
        k = h.rfind(" ")
        return h[:k] if k > int(n * 0.8) else h

    rng = random.Random(1)
    rows = [("".join(rng.choice("ab \U0001f600") if rng.random() < 0.2 else "x" for _ in range(rng.randint(0, 140))),) for _ in range(500)]
    rows += [("x" * 80 + " " + "y" * 30,), ("x" * 81 + " " + "y" * 30,), ("x" * 100,), ("x" * 101,)]
    got = spark.createDataFrame(rows, "t string").select("t", X.truncate_at_word(F.col("t"), 100).alias("c")).collect()
    assert all(r.c == cut(r.t) for r in got)


def test_dates_and_strip(spark):
    got = spark.createDataFrame([("2025-01-01T00:00:00.000Z",), ("a.000Zb.000Z",), ("x.589Z",), (" x\x1c",)], "s string").select(iso(F.col("s")).alias("d"), strip(F.col("s")).alias("t")).collect()
    assert [r.d for r in got][:3] == ["2025-01-01T00:00:00Z", "aZbZ", "x.589Z"] and got[3].t == "x"
