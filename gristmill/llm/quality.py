"""Quality rules: an isolation forest on rule statistics of each document.

Trees split on random features at random places; a document whose statistics are unlike the
accepted ones is soon alone, so its mean path is short. The forest is grown on a bounded sample
of labelled good rows, with splits anywhere in the range of all labelled rows, so that what lies
outside of the accepted range is cut off early; the threshold on the score is calibrated on a
histogram over all labelled rows of both kinds, however many there are.
Statistics are taken once over whole texts by vectorised kernels, a batch at a time; only they
are matched with labels, never the texts.

Defined cases: a null or blank text has no words, all its counts are 0, and it fails the base
rule. A text of any length is read whole. Repeated rows are judged alike, and a score that equals
the threshold is anomalous. Without labelled rows of both kinds no document is called anomalous;
of several labels of one id the lowest counts. Other columns, whatever their names, are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed
from .words import U64, BYTE_BASE, BYTE_INV, Words, mix, runs, slices, spans_hash, sums

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_marks", "n_chars")
#: Labelled good rows that the forest is grown on, at most: those of the least hashes.
MAX_LABELLED = 3000
#: Classes of scores in the histogram that the threshold is read from.
CLASSES = 4096


def statistics(column: pa.Array) -> np.ndarray:
    """A row of COUNTS + EXTRA for each text."""
    out = []
    for _, data, offsets in slices(column):
        w = Words(data, offsets)
        n = len(offsets) - 1
        per_doc = lambda mask: sums(mask, offsets)  # noqa: E731,B023
        lead = (data & 0xC0) != 0x80
        space = (data == 32) | ((data >= 9) & (data <= 13))
        # lines with a word, less the distinct ones of each document
        start, end, doc = runs(data != 10, offsets)
        full = np.concatenate([[0], np.cumsum(~space)])
        some = full[end] > full[start]
        start, end, doc = start[some], end[some], doc[some]
        h = spans_hash(data.astype(U64) + U64(1), start, end, BYTE_BASE, BYTE_INV)
        lines = np.bincount(doc, minlength=n)
        _, first = np.unique(mix(h ^ mix(doc.astype(U64))), return_index=True)
        repeated_lines = lines - np.bincount(doc[first], minlength=n)
        # words within a 3-word window that the document has twice
        at, h = w.windows(3)
        cover = np.zeros(len(w.hash) + 1, np.int64)
        if len(at):
            _, which, many = np.unique(mix(h ^ mix(w.doc[at].astype(U64))), return_inverse=True, return_counts=True)
            at = at[many[which] > 1]
            cover[at] += 1
            cover[at + 3] -= 1  # starts are distinct, so no index occurs twice
        covered = np.cumsum(cover[:-1]) > 0
        symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
        marks = (data > 32) & (data < 127) & ~((data >= 48) & (data <= 57)) & ~((data | 32 >= 97) & (data | 32 <= 122))
        out.append(np.stack([w.count, per_doc(lead & ~space), per_doc(symbol), repeated_lines, sums(covered, w.first), lines, per_doc((data >= 65) & (data <= 90)), per_doc((data >= 48) & (data <= 57)), per_doc(marks), per_doc(lead)], 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, len(COUNTS + EXTRA)), np.int64)


#: Each feature as (statistic, what it is divided by).
FEATURES = {"word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeated": ("n_repeat_words", "n_words"), "upper": ("n_upper", "n_chars"), "digits": ("n_digits", "n_chars"), "marks": ("n_marks", "n_words")}


def features(s: np.ndarray) -> np.ndarray:
    column = {c: s[:, i] for i, c in enumerate(COUNTS + EXTRA)}
    return np.stack([column[a] / np.maximum(column[b], 1) for a, b in FEATURES.values()], 1)


def feature_columns() -> dict:
    """The same features of a table of statistics."""
    return {c: F.col(a) / F.greatest(F.col(b), F.lit(1)) for c, (a, b) in FEATURES.items()}


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of a search in a random tree of n leaves."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n > 1, 1.0, 0.0))


class IsolationForest:
    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 7):
        self.trees, self.sample, self.seed, self.nodes = trees, sample, seed, []

    def fit(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> IsolationForest:
        """x: rows to grow on; low, high: range of each feature that splits are drawn from."""
        rng = np.random.default_rng(self.seed)
        size = min(self.sample, len(x))
        self.norm = float(mean_path(np.array([size]))[0]) or 1.0
        self.deepest = int(np.ceil(np.log2(max(size, 2)))) + 4
        for _ in range(self.trees):
            tree: list[tuple[int, float, int, int, float]] = []

            def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, tree=tree) -> int:
                me = len(tree)
                wide = np.flatnonzero(high > low)
                if depth >= self.deepest or len(rows) <= 1 or not len(wide):
                    tree.append((-1, 0.0, me, me, depth + float(mean_path(np.array([len(rows)]))[0])))
                    return me
                f = int(rng.choice(wide))
                cut = float(rng.uniform(low[f], high[f]))
                tree.append((f, cut, 0, 0, 0.0))
                below, above = high.copy(), low.copy()
                below[f] = above[f] = cut
                left = grow(rows[rows[:, f] < cut], low, below, depth + 1)
                right = grow(rows[rows[:, f] >= cut], above, high, depth + 1)
                tree[me] = (f, cut, left, right, 0.0)
                return me

            grow(x[rng.choice(len(x), size, replace=False)], low, high, 0)
            self.nodes.append(tuple(np.array(c) for c in zip(*tree, strict=True)))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the higher, the sooner a row is alone."""
        total = np.zeros(len(x))
        for f, cut, left, right, path in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.deepest):
                inner = f[at] >= 0
                at = np.where(inner, np.where(x[np.arange(len(x)), np.maximum(f[at], 0)] < cut[at], left[at], right[at]), at)
            total += path[at]
        return 2.0 ** (-total / (len(self.nodes) * self.norm))


def calibrated(good: np.ndarray, bad: np.ndarray, false_alarms: float) -> float:
    """The threshold of the best balanced accuracy among those that reject at most this share of good rows.

    good, bad: number of rows of each kind by class of score. 2.0, which no score reaches, without rows of both kinds.
    """
    if not good.sum() or not bad.sum():
        return 2.0
    above = lambda n: np.append(np.cumsum(n[::-1])[::-1], 0) / n.sum()
    good_hit, bad_hit = above(good), above(bad)
    allowed = np.flatnonzero(good_hit <= false_alarms)
    gain = (bad_hit - good_hit)[allowed]
    best = allowed[gain == gain.max()]
    return float((best[0] + best[-1]) / 2 / CLASSES)  # in the middle of a gap between the kinds


FIELDS = COUNTS + EXTRA
_SCHEMA = ", ".join(f"{c} long" for c in FIELDS)


def _table(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy() for c in FIELDS], 1)


def statistics_of(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""

    def f(batches):
        for b in batches:
            s = statistics(b.column("text"))
            yield pa.record_batch({"doc_id": b.column("doc_id"), **{c: s[:, i] for i, c in enumerate(FIELDS)}})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(f, "doc_id long, " + _SCHEMA)


def fit_forest(stats: DataFrame, labels: DataFrame, false_alarms: float = 0.01) -> tuple[IsolationForest | None, float]:
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    rows = checkpointed(stats.where("n_words >= 50").join(own.groupBy("doc_id").agg(F.min("label").alias("label")), "doc_id"))
    low_high = [f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in FEATURES]
    ends = rows.select(*(e.alias(c) for c, e in feature_columns().items())).agg(*low_high).first()
    sample = rows.where("label = 1").orderBy(F.xxhash64("doc_id", *FIELDS), "doc_id").limit(MAX_LABELLED).toArrow()
    if sample.num_rows < 2:
        return None, 2.0
    s = np.stack([sample[c].to_numpy() for c in FIELDS], 1)
    s = s[np.lexsort(s.T)]  # rows come in any order; the forest must not depend on it
    forest = IsolationForest().fit(features(s), np.array([ends[f"low_{c}"] for c in FEATURES]), np.array([ends[f"high_{c}"] for c in FEATURES]))

    def histogram(batches):
        many = np.zeros(2 * CLASSES, np.int64)
        for b in batches:
            at = np.minimum((forest.score(features(_table(b))) * CLASSES).astype(np.int64), CLASSES - 1)
            many += np.bincount(b.column("label").to_numpy() * CLASSES + at, minlength=2 * CLASSES)
        some = np.flatnonzero(many)
        yield pa.record_batch({"place": some, "n": many[some]})

    many = np.zeros(2 * CLASSES, np.int64)
    for row in rows.mapInArrow(histogram, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        many[row.place] = row.n
    return forest, calibrated(many[CLASSES:], many[:CLASSES], false_alarms)


def quality_filter(docs: DataFrame, labels: DataFrame, false_alarms: float = 0.01) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the anomaly score of every document."""
    stats = checkpointed(statistics_of(docs))
    forest, threshold = fit_forest(stats, labels, false_alarms)

    def judge(batches):
        for b in batches:
            s = _table(b)
            failed = (s[:, 0] < 50) | (100 * s[:, 4] > 50 * s[:, 0])
            score = forest.score(features(s)) if forest and len(s) else np.zeros(len(s))
            yield pa.record_batch({"doc_id": b.column("doc_id"), **{c: s[:, i] for i, c in enumerate(COUNTS)}, "base_failed": failed, "kept": ~failed & (score < threshold), "anomaly": score})

    return stats.mapInArrow(judge, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")
