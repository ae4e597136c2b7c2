"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is itself and its character n-grams, each with an embedding; a document is the mean of
its words' means. Embeddings and softmax weights are trained together, so a misspelling that
was never seen still has most of its n-grams' vectors. The labels come from a bounded sample of
the training fold; how common a word is, is counted over all documents. As the softmax is linear
in the mean, a trained model is scored by the one number that each embedding adds to the logit,
which gives the same results.

Defined cases: a null text, or one without letters, has the score of an empty bag (the bias).
A text of any length is scored whole; very long ones are no samples (samples.MAX_CHARS). Repeated
rows score alike; in training a doc_id counts once, by the row whose text has the least hash and the lowest of
its labels, and labels without a document do not count. A score of exactly one half is predicted toxic. With labels of one class
only, every score is that class's share. Labels, lang, source and doc_id are no inputs of a score,
and other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed
from .letters import LetterWords, find, text_slices
from .samples import fold, known, sample
from .words import U64

#: Embeddings are kept in so many hashed places.
PLACES = 1 << 17
DIM = 2
SIZES = (3, 4, 5)
#: Labelled rows of each class in training, at most; the bias is set right for the true share of the classes.
MAX_LABELLED = 2500
#: Bytes of their texts, at most, of each class.
MAX_BYTES = 48 << 20
EPOCHS, RATE = 80, 0.02
#: Penalties on embeddings, in units of what pure noise would pull; and in how many documents a place must be.
PENALTY, REFIT, LEAST_DOCS = 0.7, 0.05, 4
#: Characters of training texts that are multiplied out together, and entries that a product reads together.
TRAINING_CHARS, ENTRIES = 1 << 17, 1 << 19
#: Counts of words that a task holds before it passes them on.
HELD = 1 << 18
#: Share of all running words from which on a word counts for less than half.
RARE = 1e-3


def subwords(w: LetterWords) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word, place) of each word and each of its n-grams."""
    parts = [(np.arange(len(w.hash)), w.hash), *(w.ngrams(n) for n in SIZES)]
    word, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return word, ((h >> U64(20)) % U64(PLACES)).astype(np.int64)


class Weights:
    """a / (a + share) for each word: the more of all running words it makes up, the less it counts in a mean."""

    def __init__(self, hashes: np.ndarray, share: np.ndarray):
        often = share > RARE / 100
        self.hashes, self.weight = hashes[often], RARE / (RARE + share[often])

    def of(self, w: LetterWords) -> np.ndarray:
        at = find(self.hashes, w.hash)
        return np.where(at >= 0, self.weight[at], 1.0) if len(self.hashes) else np.ones(len(w.hash))

    @classmethod
    def count(cls, texts: pa.Array) -> Weights:
        h, n = np.zeros(0, U64), np.zeros(0)
        for _, part in text_slices(texts, TRAINING_CHARS):
            w = LetterWords(part)
            h, at = np.unique(np.concatenate([h, w.hash]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, np.bincount(w.which, minlength=len(w.hash))]), len(h))
        return cls(h, n / max(n.sum(), 1))

    @classmethod
    def over(cls, docs: DataFrame) -> Weights:
        """Counted over all documents, where they are; only words above the fixed share come to the driver, 100 / RARE at most."""

        def tally(held):
            h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return pa.record_batch({"h": h.view(np.int64), "n": np.bincount(at, np.concatenate([x[1] for x in held]), len(h)).astype(np.int64)})

        def count(batches):
            held, size = [], 0
            for batch in batches:
                for _, part in text_slices(batch.column("text")):
                    w = LetterWords(part)
                    held.append((w.hash, np.bincount(w.which, minlength=len(w.hash))))
                    size += len(w.hash)
                    if size > HELD:
                        yield tally(held)
                        held, size = [], 0
            if held:
                yield tally(held)

        words = checkpointed(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
        total = words.agg(F.sum("n")).first()[0] or 1
        got = words.where(F.col("n") > RARE / 100 * total).toArrow()
        h, n = got["h"].to_numpy().view(U64), got["n"].to_numpy()
        order = np.argsort(h)
        return cls(h[order], n[order] / total)


def bags(w: LetterWords, weights: Weights):
    """(document, word, weight) of a slice, (number of places of each word, places), and of each place the number and the squared weights of the documents that have it."""
    word, place = subwords(w)
    order = np.argsort(word, kind="stable")
    word, place = word[order], place[order]
    first = np.searchsorted(word, np.arange(len(w.hash) + 1))
    pair, many = np.unique(w.doc * np.int64(len(w.hash)) + w.which, return_counts=True)
    doc, own = pair // max(len(w.hash), 1), pair % max(len(w.hash), 1)
    length = np.diff(first)
    own_weight = weights.of(w)
    total = np.bincount(w.doc, own_weight[w.which], w.n)
    share = many * own_weight[own] / total[doc] / length[own]
    # multiplied out for this slice only, each place once for each document
    each = length[own]
    index = np.arange(each.sum()) + np.repeat(first[own] - np.concatenate([[0], np.cumsum(each)[:-1]]), each)
    key, at = np.unique(np.repeat(doc, each) * np.int64(PLACES) + place[index], return_inverse=True)
    weight, at = np.bincount(at, np.repeat(share, each)), key % PLACES
    return (doc, own, share), (length, place), np.bincount(at, minlength=PLACES), np.bincount(at, weight**2, PLACES)


def give_back() -> None:
    """What arrays have freed goes back to the system now, where the C library can, so that it does not add to what the driver's JVM has."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def starts(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and where each begins."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
    return ordered[first], first


class Sparse:
    """A sparse matrix that is read by row and by column; the entries are sorted by row. Without weights each entry is 1."""

    def __init__(self, row: np.ndarray, col: np.ndarray, rows: int, cols: int, weight: np.ndarray | None = None):
        self.col, self.rows, self.cols, self.weight = col, rows, cols, weight
        self.row_at = starts(row)
        order = np.argsort(col, kind="stable")
        self.by_row, self.by_weight = row[order], None if weight is None else weight[order]
        del order
        self.col_at = starts(np.sort(col))

    @staticmethod
    def sums(values: np.ndarray, at: np.ndarray, weight: np.ndarray | None, n: int, filled: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The sum of each filled row's entries, so many entries at a time."""
        out = np.zeros((n, values.shape[1]), np.float32)
        which, start = filled
        cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(at), ENTRIES)), len(start)))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = slice(start[lo], start[hi] if hi < len(start) else len(at))
            got = values[at[part]]
            if weight is not None:
                got *= weight[part, None]
            out[which[lo:hi]] = np.add.reduceat(got, start[lo:hi] - start[lo], axis=0)
        return out

    def times(self, e: np.ndarray) -> np.ndarray:
        return self.sums(e, self.col, self.weight, self.rows, self.row_at)

    def back(self, d: np.ndarray) -> np.ndarray:
        return self.sums(d, self.by_row, self.by_weight, self.cols, self.col_at)


class Bags:
    """Documents by places, as documents by words and words by places: a word's places are held once, not for each document."""

    def __init__(self, docs: Sparse, words: Sparse, scale: np.ndarray):
        self.docs, self.words, self.scale, self.n, self.places = docs, words, scale.astype(np.float32)[:, None], docs.rows, words.cols

    def only(self, places: np.ndarray) -> Bags:
        w = self.words
        keep = np.zeros(w.cols, bool)
        keep[places] = True
        keep = keep[w.col]
        row = np.repeat(w.row_at[0].astype(np.int32), np.diff(np.append(w.row_at[1], len(w.col))))[keep]
        return Bags(self.docs, Sparse(row, np.searchsorted(places, w.col[keep]).astype(np.int32), w.rows, len(places)), self.scale[places, 0])

    def means(self, e: np.ndarray) -> np.ndarray:
        return self.docs.times(self.words.times(e / self.scale))

    def back(self, d: np.ndarray) -> np.ndarray:
        return self.words.back(self.docs.back(d)) / self.scale

    @classmethod
    def build(cls, column: pa.Array, weights: Weights, least: int) -> tuple[Bags, np.ndarray, np.ndarray]:
        """Bags of the places that at least so many documents have, each place at the same scale; number and scale of these places."""
        known, parts, letters = np.zeros(0, U64), [], [(np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
        many, squares, n = np.zeros(PLACES, np.int64), np.zeros(PLACES), len(column)
        for lo, texts in text_slices(column, TRAINING_CHARS):
            w = LetterWords(texts)
            (doc, own, share), (length, place), docs_of, squares_of = bags(w, weights)
            many += docs_of
            squares += squares_of
            parts.append(((doc + lo).astype(np.int32), w.hash, own.astype(np.int32), share.astype(np.float32)))
            fresh = find(known, w.hash) < 0
            letters.append((w.hash[fresh], length[fresh].astype(np.int32), place[np.repeat(fresh, length)].astype(np.int32)))
            known = np.union1d(known, w.hash)
        used = np.flatnonzero(many >= least)
        scale = np.sqrt(squares[used] / max(n, 1))
        # words are numbered as they are first seen, so that their places are in order
        seen, length, place = (np.concatenate([x[k] for x in letters]) for k in range(3))
        del letters
        number = np.argsort(seen).astype(np.int32)
        own = [number[np.searchsorted(known, h)][o] for _, h, o, _ in parts]
        doc, share = ([p[k] for p in parts] for k in (0, 3))
        del parts, known, number
        doc, own, share = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((doc, np.int32), (own, np.int32), (share, np.float32)))
        keep = (many >= least)[place]
        word = np.repeat(np.arange(len(seen), dtype=np.int32), length)[keep]
        to = np.zeros(PLACES, np.int32)
        to[used] = np.arange(len(used))
        place = to[place[keep]]
        del keep
        give_back()
        own_docs = Sparse(doc, own, n, len(seen), share)
        del doc, own, share
        give_back()
        built = cls(own_docs, Sparse(word, place, len(seen), len(used)), scale)
        del word, place
        give_back()
        return built, used, scale


def descend(x: Bags, target: np.ndarray, e: np.ndarray, v: np.ndarray, b: np.ndarray, penalty: float):
    """Embeddings, softmax weights and biases together: accelerated descent, embeddings shrunk towards 0 at each step."""
    probe = np.ones((x.places, 1), np.float32)
    for _ in range(8):
        probe = x.back(x.means(probe / np.linalg.norm(probe)))
    step = 4 * x.n / float(np.linalg.norm(probe)) / float((v**2).sum())
    ahead = e
    for epoch in range(EPOCHS):
        h = x.means(ahead)
        z = h @ v + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - target) / x.n
        moved = ahead - step * x.back(g @ v.T)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        ahead = new + (epoch / (epoch + 3)) * (new - e)
        e, v, b = new, v - RATE * (h.T @ g), b - g.sum(0)
    return e, v, b


class Model:
    """places: what the softmax adds to the logit of class 1 for each embedding."""

    def __init__(self, places: np.ndarray, bias: float, weights: Weights):
        self.places, self.bias, self.weights = places.astype(np.float32), bias, weights

    @classmethod
    def constant(cls, share: float) -> Model:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return cls(np.zeros(PLACES), float(np.log(share / (1 - share))), Weights(np.zeros(0, U64), np.zeros(0)))

    @classmethod
    def fit(cls, texts: list[str] | pa.Array | pa.ChunkedArray, label: np.ndarray, share: float | None = None, weights: Weights | None = None, seed: int = 11) -> Model:
        if not len(texts) or label.min() == label.max():
            return cls.constant(float(label.mean()) if len(texts) else 0.0)
        column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
        del texts
        n = len(column)
        weights = weights or Weights.count(column)
        # each place at the same scale, so that one penalty suits all of them
        x, used, scale = Bags.build(column, weights, max(LEAST_DOCS, n // 1000))
        del column  # the texts are not needed for the descent
        if not len(used):
            return cls.constant(float(label.mean()))
        target = np.stack([1 - label, label], 1).astype(np.float32)
        start = np.log(target.mean(0))
        noise = float(np.sqrt(target.mean(0).prod() / n) * np.sqrt(2 * np.log(len(used) + 1)))
        rng = np.random.default_rng(seed)
        v = np.array([[-0.5, 0.5], [0.5, -0.5]], np.float32) + rng.normal(0, 0.05, (DIM, 2)).astype(np.float32)
        e, v, b = descend(x, target, np.zeros((len(used), DIM), np.float32), v, start.astype(np.float32), PENALTY * noise)
        # the places that the penalty left are trained again, now almost without it
        live = np.flatnonzero(np.abs(e).sum(1) > 0)
        out = np.zeros(PLACES, np.float32)
        if len(live):
            e, v, b = descend(x.only(live), target, e[live], v, b, REFIT * noise)
            out[used[live]] = e @ (v[:, 1] - v[:, 0]) / scale[live]
        del x
        give_back()
        bias = float(b[1] - b[0])
        if share is not None and 0 < share < 1:
            bias += float(np.log(share / (1 - share)) - np.log(label.mean() / (1 - label.mean())))
        return cls(out, bias, weights)

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, texts in text_slices(column):
            w = LetterWords(texts)
            word, place = subwords(w)
            mean = np.bincount(word, self.places[place], len(w.hash)) / np.maximum(np.bincount(word, minlength=len(w.hash)), 1)
            own = self.weights.of(w)
            total = np.bincount(w.doc, (own * mean)[w.which], w.n) if len(w.which) else np.zeros(w.n)
            mass = np.bincount(w.doc, own[w.which], w.n) if len(w.which) else np.zeros(w.n)
            out.append(1 / (1 + np.exp(-np.clip(self.bias + total / np.where(mass > 0, mass, 1), -500, 500))))
        return np.concatenate(out) if out else np.zeros(0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Model:
    rows = checkpointed(known(docs, labels, "toxic", folds, held))
    got = sample(docs, rows, MAX_LABELLED, MAX_BYTES).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    share = rows.agg(F.avg("label")).first()[0]
    weights = Weights.over(docs)
    label, texts = got["label"].to_numpy().astype(np.float32), [got["text"]]
    del got
    return Model.fit(texts.pop(), label, share, weights)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit_toxicity(docs, labels, folds, held)

    def judge(batches):
        for batch in batches:
            s = model.score(batch.column("text"))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """The rows of docs, all columns, whose text scores below one half, or has no letter. Without labels of both classes all stay."""
    model = fit_toxicity(docs, labels, folds, held)
    if not model.places.any():
        return docs
    # a column of its own beside the rows: no join, and other columns never leave the JVM
    score = F.arrow_udf(lambda text: pa.array(model.score(text)), "double")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where((score(text) < 0.5) | ~text.rlike(r"\p{L}"))
