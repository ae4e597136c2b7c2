import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from gristmill.llm.url_filter import CLASSES, ORDER, RULES, WIDTH, MarkovModel, UrlModel, host_and_path, matching_rule, url_filter
from pyspark.sql import functions as F

URLS = ["https://www.Example.org/en/1/x?y#z", "http://a.example.org/es/q", "https://x.org", "https://x.org/", "ftp://b.com/fr/a", "no scheme", None, "", "http://notexample.org/es/1", "http://h.net/p?q=://x.com/de/", "http://u.com/de/é", "HTTP://ORG/a", "://c.com/fr/\nb"]


def brute(u):
    host = path = ""
    if "://" in (u or ""):
        rest = u.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for kind, rule in RULES:
        own, start = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (kind, rule)
    return host, path, best


def test_rules(spark):
    rows = spark.createDataFrame(list(enumerate(URLS)), "i int, url string")
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    for r in rows.select("*", rule.alias("rule"), verdict.alias("verdict")).collect():
        assert (r.host, r.path, (r.verdict, r.rule) if r.rule else None) == brute(r.url), r


def test_markov_model_equals_plain_recursion():
    train, own = ["http://a.b/c", "http://a.b/d", "https://x"], "http://a.x/cc"
    follow = defaultdict(Counter)
    for u in train:
        b = u.encode()
        for i in range(len(b)):
            for k in range(min(i, ORDER) + 1):
                follow[b[i - k : i]][b[i]] += 1
    want, b = 0.0, own.encode()
    for i in range(len(b)):
        p = 1 / 256
        for k in range(min(i, ORDER) + 1):
            f = follow.get(b[i - k : i])
            if f:
                p = (f[b[i]] + len(f) * p) / (sum(f.values()) + len(f))
        want += math.log(p)
    data = np.frombuffer(b, np.uint8)
    assert math.isclose(MarkovModel(pa.array(train)).per_byte(data, np.zeros(len(data), np.int64)).sum(), want, rel_tol=1e-9)


def test_method_separates_what_rules_leave_open(spark):
    good = [(i, f"https://www.site{i % 9}.org/en/story-{i}") for i in range(200)]
    bad = [(1000 + i, f"http://cheap-pills{i % 9}.com/de/buy{i}?ref=x") for i in range(200)]
    open_ = [(2000 + i, f"https://www.site{i}.net/en/story-{i}") for i in range(50)] + [(3000 + i, f"http://cheap-pills{i}.net/buy{i}?ref=x") for i in range(50)]
    pages = spark.createDataFrame(good + bad + open_ + [(9, None), (9, None)], "page_id long, url string").withColumn("html", F.lit("")).withColumn("rule", F.lit("clash"))
    got = url_filter(pages).where("rule IS NULL AND page_id >= 2000").collect()
    assert sum((r.page_id < 3000) == (r.verdict == "allow") for r in got) >= 95
    assert url_filter(pages).count() == 502


def test_empty(spark):
    assert url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
    got = url_filter(spark.createDataFrame([(1, None), (2, "http://a.net/")], "page_id long, url string")).collect()
    assert all(r.verdict == "allow" and r.rule is None for r in got)


def test_threshold_and_long_urls(spark):
    good = [(i, f"https://www.site{i % 9}.org/en/story-{i}") for i in range(200)]
    bad = [(1000 + i, f"http://cheap-pills{i % 9}.com/de/buy{i}?ref=x") for i in range(200)]
    long_ = [(5000, "http://cheap-pills3.net/buy" + "?ref=x" * 20_000), (5001, "http://cheap-pills3.net/buy" + "?ref=x" * 20_000)]
    got = {r.page_id: r for r in url_filter(spark.createDataFrame(good + bad + long_, "page_id long, url string")).collect()}
    assert got[5000].verdict == got[5001].verdict == "block" and got[5000].difference == got[5001].difference
    # few and only equal URLs: calibrated on what there is
    few = [(i, "https://a.org/x") for i in range(3)] + [(i, "https://b.org/x") for i in range(3)] + [(9, "http://c.com/de/1"), (9, "http://c.com/de/2"), (10, "http://c.net/de/3")]
    assert {r.page_id: r.verdict for r in url_filter(spark.createDataFrame(few, "page_id long, url string")).collect()}[10] == "block"


def test_calibration_takes_the_best_cut():
    model = UrlModel(pa.array(["ab", "ac"]), pa.array(["xy", "xz"]))
    rng = np.random.default_rng(2)
    good, bad = rng.integers(4000, 5000, 300), rng.integers(3500, 4400, 300)
    model.calibrate(np.bincount(good, minlength=CLASSES), np.bincount(bad, minlength=CLASSES))
    cut = (model.threshold + WIDTH) / (2 * WIDTH) * CLASSES
    right = lambda t: np.mean(good >= t) + np.mean(bad < t)
    assert right(cut) == max(right(t) for t in range(3400, 5100))
