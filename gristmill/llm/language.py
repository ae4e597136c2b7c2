"""Language ID by word-first backoff.

A word seen in training scores by its log frequency in each language. A word never seen falls
back to its longest character n-grams that were seen, from five characters down to one. What a
word says is normalised over the languages, and a document is the sum over its words. Word and
n-gram counts come from a bounded sample of each language's labelled documents outside the
held-out fold.

Defined cases: a null text, or one without a letter, is `und` with score 0. Ties go to the
first language in alphabetical order. Repeated rows are judged alike; in training a doc_id counts once for
each language, by the row whose text has the least hash. Without a labelled
training document everything is `und`. A text of any length is judged whole; very long ones are no
samples (samples.MAX_CHARS). lang, source and doc_id are no inputs of a prediction, and other
columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .letters import LetterWords, find, text_slices
from .samples import MAX_CHARS, fold

#: Labelled documents of each language to learn from: those of the least hashes, as many as this and up to one in STEPS more.
MAX_LABELLED, STEPS = 4000, 16
#: Bytes of their texts, of each language: as many and up to one in STEPS more.
MAX_BYTES = 48 << 20
#: Characters of the longest n-gram.
LONGEST = 5
#: Counts that wait, at least, before they are added up.
PENDING = 1 << 17


class Tally:
    """Counts by key of many slices, which never holds much more than its distinct keys."""

    def __init__(self):
        self.keys, self.many = np.zeros(0, np.uint64), np.zeros(0)
        self.waiting, self.size = [], 0

    def add(self, keys: np.ndarray, many: np.ndarray) -> None:
        self.waiting.append((keys, many))
        self.size += len(keys)
        if self.size > max(PENDING, len(self.keys)):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
            many = np.concatenate([self.many, *(m for _, m in self.waiting)])
            self.waiting, self.size = [], 0
            self.keys, at = np.unique(keys, return_inverse=True)
            self.many = np.bincount(at, many, len(self.keys))
        return self.keys, self.many


class Model:
    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]):
        #: tables[0]: words; tables[n]: n-grams. Each: sorted hashes, and a row of normalised log scores.
        self.langs, self.tables = langs, tables

    @classmethod
    def fit(cls, texts: list[str] | pa.ChunkedArray, lang: list[str]) -> Model:
        """The order of the rows does not matter: counts are whole numbers."""
        langs = sorted(set(lang))
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        found: list[list] = [[] for _ in range(LONGEST + 1)]
        for k, name in enumerate(langs):
            tallies = [Tally() for _ in range(LONGEST + 1)]
            for _, part in text_slices(texts.filter(pa.array([x == name for x in lang]))):
                w = LetterWords(part)
                many = np.bincount(w.which, minlength=len(w.hash))
                tallies[0].add(w.hash, many)
                for n in range(1, LONGEST + 1):
                    word, h = w.ngrams(n)
                    keys, at = np.unique(h, return_inverse=True)
                    tallies[n].add(keys, np.bincount(at, many[word], len(keys)))
            for n in range(LONGEST + 1):
                found[n].append((*tallies[n].total(), k))
        tables = []
        for parts in found:
            if not parts:
                tables.append((np.zeros(0, np.uint64), np.zeros((0, max(len(langs), 1)))))
                continue
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.zeros((len(keys), len(langs)))
            lo = 0
            for h, many, k in parts:
                counts[at[lo : lo + len(h)], k] = many
                lo += len(h)
            total = counts.sum(0)
            score = np.log((counts + 0.5) / (total + 0.5 * (len(keys) + 1)))
            top = score.max(1, keepdims=True)
            tables.append((keys, score - top - np.log(np.exp(score - top).sum(1, keepdims=True))))
        return cls(langs, tables)

    def word_scores(self, w: LetterWords) -> np.ndarray:
        out = np.zeros((len(w.hash), len(self.langs)))
        at = find(self.tables[0][0], w.hash)
        out[at >= 0] = self.tables[0][1][at[at >= 0]]
        open_ = at < 0
        for n in range(LONGEST, 0, -1):
            if not open_.any():
                break
            word, h = w.ngrams(n)
            mine = open_[word]
            word, at = word[mine], find(self.tables[n][0], h[mine])
            word, at = word[at >= 0], at[at >= 0]
            many = np.bincount(word, minlength=len(w.hash))
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(word, self.tables[n][1][at, k], len(w.hash)) / np.maximum(many, 1)
            open_ &= many == 0
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language (-1: und) and its share of the probability."""
        best, share = [], []
        for _, texts in text_slices(column):
            w = LetterWords(texts)
            scores = self.word_scores(w)
            total = np.stack([np.bincount(w.doc, scores[w.which, k], w.n) if len(w.which) else np.zeros(w.n) for k in range(len(self.langs))], 1)
            top = total.max(1, keepdims=True)
            p = 1 / np.exp(total - top).sum(1)
            some = np.diff(w.first) > 0
            best.append(np.where(some, total.argmax(1), -1))
            share.append(np.where(some, p, 0.0))
        return (np.concatenate(best), np.concatenate(share)) if best else (np.zeros(0, np.int64), np.zeros(0))


def usable(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, lang, text and place (the higher, the lower the hash of the id) of every row that can be learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held) & F.col("text").isNotNull() & (F.length("text") <= MAX_CHARS))
    share = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5
    return rows.withColumn("place", F.floor(-STEPS * F.log2(F.greatest(share, F.lit(2.0**-50)))))


def fit_language(docs: DataFrame, folds: int = 4, held: int = 2) -> Model:
    rows = usable(docs, folds, held)
    # counts and bytes by place tell where a language has enough documents; an id counts once, by the text of the least hash
    own = rows.groupBy("lang", "doc_id", "place").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("bytes"))).alias("t"))
    counts = own.groupBy("lang", "place").agg(F.count(F.lit(1)).alias("n"), F.sum("t.bytes").alias("bytes"))
    before = Window.partitionBy("lang").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    least = counts.withColumns({"higher": F.coalesce(F.sum("n").over(before), F.lit(0)), "upto": F.coalesce(F.sum("bytes").over(before), F.lit(0))})
    least = least.where((F.col("higher") < MAX_LABELLED) & (F.col("upto") < MAX_BYTES)).groupBy("lang").agg(F.min("place").alias("least"))
    # then only the texts of a bounded sample move, rows of an id reduced to one before they do
    texts = rows.join(F.broadcast(least), "lang").where("place >= least").groupBy("lang", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    got = texts.select("lang", "t.text").toArrow()
    return Model.fit(got["text"], got["lang"].to_pylist())


def language_id(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fit_language(docs, folds, held)

    def judge(batches):
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            if model.langs:
                best, share = model.predict(batch.column("text"))
            else:
                best, share = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(names[best], pa.string()), "score": share})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double")
