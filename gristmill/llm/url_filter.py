"""URL filter: rules first, then the ratio of two character language models.

Two variable-order Markov models, one of accepted and one of rejected URLs, give the chance of
each byte after the longest context seen; shorter contexts are blended in by Witten-Bell
smoothing, down to a uniform one. A URL is judged by the difference of the two log-likelihoods
divided by its length, against a threshold calibrated on URLs that the models were not fitted
on. Accepted and rejected URLs to learn from are those that a rule decides: models are fitted on
a bounded sample of four fifths of them, and the threshold comes from a histogram over all rows
of the last fifth, however many there are.

Defined cases: a null URL, or one without `://`, has an empty host and path and fits no rule; a
null one is scored as an empty text, whose difference is 0. Repeated rows are judged alike, and a
difference that equals the threshold is allowed. A URL of any length is scored whole; those of
more than MAX_LENGTH characters are no samples.
Without URLs of both kinds to learn from, the method allows everything. Other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .letters import find
from .words import U64, slices

#: Bytes of the longest context.
ORDER = 6
#: Distinct URLs of each kind to learn from, at most, and their length; one in CALIBRATION of all is kept for the threshold.
MAX_URLS, MAX_LENGTH, CALIBRATION = 20_000, 4096, 5
#: The histogram of differences: its width on either side of 0, and its classes.
WIDTH, CLASSES = 16.0, 8192
#: Rules of the production filter: verdict, then host and path as one string.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, rest, 1), _UPPER, _LOWER), F.regexp_extract(url, rest, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own_host, own_path = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(data: np.ndarray, doc_start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the last byte, key) of each run of n bytes within a URL; the key is exact."""
    at = np.arange(n - 1, len(data))
    at = at[at - (n - 1) >= doc_start[at]]
    key = np.full(len(at), U64(n) << U64(57))
    for k in range(n):
        key |= data[at - k].astype(U64) << U64(8 * k)
    return at, key


class MarkovModel:
    """levels[k]: keys and counts of contexts of k bytes plus one; keys, totals and kinds of followers of the contexts."""

    def __init__(self, urls: pa.Array):
        self.levels = []
        parts = [[] for _ in range(ORDER + 1)]
        for _, data, offsets in slices(urls):
            start = np.repeat(offsets[:-1], np.diff(offsets))
            for k in range(ORDER + 1):
                parts[k].append(_grams(data, start, k + 1)[1])
        for k in range(ORDER + 1):
            keys, many = np.unique(np.concatenate(parts[k]) if parts[k] else np.zeros(0, U64), return_counts=True)
            context, at = np.unique((keys & U64(2**57 - 1)) >> U64(8), return_inverse=True)
            self.levels.append((keys, many, context, np.bincount(at, many), np.bincount(at)))

    def per_byte(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Log chance of each byte after those before it in the same URL."""
        p = np.full(len(data), 1 / 256)
        for k, (keys, many, context, total, kinds) in enumerate(self.levels):
            at, key = _grams(data, start, k + 1)
            c = find(context, (key & U64(2**57 - 1)) >> U64(8))
            seen = c >= 0
            at, key, c = at[seen], key[seen], c[seen]
            f = find(keys, key)
            count = np.where(f >= 0, many[np.maximum(f, 0)], 0) if len(keys) else np.zeros(len(at))
            p[at] = (count + kinds[c] * p[at]) / (total[c] + kinds[c])
        return np.log(p)


class UrlModel:
    def __init__(self, accepted: pa.Array, rejected: pa.Array):
        self.usable = len(accepted) >= 2 and len(rejected) >= 2
        self.threshold = -np.inf
        if self.usable:
            self.good, self.bad = MarkovModel(accepted), MarkovModel(rejected)

    def places(self, urls: pa.Array) -> np.ndarray:
        """Class of each URL's difference in the histogram."""
        return np.clip(((self.difference(urls) + WIDTH) / (2 * WIDTH) * CLASSES).astype(np.int64), 0, CLASSES - 1)

    def calibrate(self, good: np.ndarray, bad: np.ndarray) -> None:
        """Sets the threshold that decides most URLs of both kinds rightly, by numbers of them in each class."""
        if not good.sum() or not bad.sum():
            return
        below = lambda n: np.concatenate([[0], np.cumsum(n)]) / n.sum()
        right = (1 - below(good)) + below(bad)
        best = np.flatnonzero(right == right.max())
        self.threshold = float((best[0] + best[-1]) / 2 / CLASSES * 2 * WIDTH - WIDTH)  # in the middle of a gap

    def difference(self, urls: pa.Array) -> np.ndarray:
        """Log-likelihood as an accepted URL less that as a rejected one, for each byte."""
        out = []
        for _, data, offsets in slices(urls):
            start = np.repeat(offsets[:-1], np.diff(offsets))
            length = np.diff(offsets)
            # each URL summed by itself, so that equal ones have equal sums wherever they stand
            d = np.append(self.good.per_byte(data, start) - self.bad.per_byte(data, start), 0.0)
            out.append(np.where(length > 0, np.add.reduceat(d, offsets[:-1]), 0.0) / np.maximum(length, 1))
        return np.concatenate(out) if out else np.zeros(0)


def fit_urls(judged: DataFrame) -> UrlModel:
    """judged: url, verdict of the rules (null where none fits)."""
    # equal URLs share a fold; a table with none in the last one is calibrated on what it has
    decided = judged.where(F.col("verdict").isin("allow", "block") & F.col("url").isNotNull()).withColumn("held", F.pmod(F.xxhash64("url", F.lit(CALIBRATION)), F.lit(CALIBRATION)) == 0)
    there = {(r.verdict, r.held) for r in decided.groupBy("verdict", "held").count().collect()}
    every = not {("allow", True), ("block", True), ("allow", False), ("block", False)} <= there
    kinds = []
    for kind in ("allow", "block"):
        # most rows share few texts, so equal ones are merged before the least hashes are taken
        own = decided.where((F.col("verdict") == kind) & (F.length("url") <= MAX_LENGTH) & (F.lit(every) | ~F.col("held"))).groupBy("url").agg(F.count(F.lit(1)).alias("n"))
        got = own.orderBy(F.xxhash64("url"), "url").limit(MAX_URLS).select("url").toArrow()["url"].combine_chunks()
        kinds.append(got if isinstance(got, pa.Array) else pa.concat_arrays(got.chunks))
    model = UrlModel(*kinds)
    if not model.usable:
        return model

    def histogram(batches):
        many = np.zeros(2 * CLASSES, np.int64)
        for b in batches:
            good = b.column("good").to_numpy(zero_copy_only=False)
            many += np.bincount(model.places(b.column("url")) + CLASSES * good, minlength=2 * CLASSES)
        some = np.flatnonzero(many)
        yield pa.record_batch({"place": some, "n": many[some]})

    many = np.zeros(2 * CLASSES, np.int64)
    held = decided.where(F.lit(every) | F.col("held")).select("url", (F.col("verdict") == "allow").alias("good"))
    for row in held.mapInArrow(histogram, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        many[row.place] = row.n
    model.calibrate(many[CLASSES:], many[:CLASSES])
    return model


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's difference of every page."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    model = fit_urls(rows.select("url", "verdict"))

    def judge(batches):
        for b in batches:
            d = model.difference(b.column("url")) if model.usable else np.zeros(b.num_rows)
            own = pa.array(np.where(d >= model.threshold, "allow", "block").astype(object), pa.string())
            names = b.schema.names
            cols = {n: b.column(names.index(n)) for n in ("page_id", "host", "path", "rule")}
            given = b.column(names.index("verdict"))
            yield pa.record_batch({**cols, "verdict": given.fill_null("") if not given.null_count else pa.array([x if x is not None else y for x, y in zip(given.to_pylist(), own.to_pylist(), strict=True)], pa.string()), "difference": d})

    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, difference double")
