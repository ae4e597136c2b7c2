"""Entity decoding against Python's, without Python in the plan."""

import html
import html.entities
import random

from gristmill.functions.entities import unescape, unescape_all
from pyspark.sql import functions as F


def decoded(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", unescape(F.col("t")).alias("t"))
    return [r.t for r in sorted(df.collect())]


def test_every_name(spark):
    names = sorted(html.entities.html5)
    texts = [f"&{n}" for n in names] + [f"a &{n}tail b" for n in names] + [f"&{n.rstrip(';')};;" for n in names]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_numbers(spark):
    edge = [0, 1, 8, 9, 10, 11, 13, 14, 31, 32, 38, 127, *range(126, 163), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFE, 0x10FFFF, 0x110000, 10**8, 10**9, 16**8, 10**30]
    texts = [f for n in edge for f in (f"&#{n};", f"&#{n}", f"&#x{n:x};", f"&#X{n:X}z", f"&#000000000000{n};", f"&#x0000000000{n:x};")]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_fuzz(spark):
    rng = random.Random(8)
    bits = ["&", "#", "x", "X", ";", "amp", "lt", "not", "notin", "copy", "Copy", "hellip", "zwj", "&amp;", "&lt;", "12", "af", " ", "\n", "\t", "\f", "<", "é", "😀", "x" * 40, "CounterClockwiseContourIntegral", "&#", "&#x", "0"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(4000)] + ["", "&", "&;", "&&", "&a", "&#;", "&#x;", "&am", "&\n;"]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_lists_nulls_and_plan(spark):
    df = spark.createDataFrame([(["a &lt; b", None, "c"],), (None,), ([],)], "t array<string>").select(unescape_all(F.col("t")).alias("t"))
    assert [r.t for r in df.collect()] == [["a < b", None, "c"], None, []]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "PythonUDF" not in plan
