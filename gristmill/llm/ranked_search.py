"""Ranked lexical search by three rounds of uniform thresholds over postings partitioned by term.

1. The documents are cut into shards of bounded size; in a shard the postings of every asked term
   are one list (the list of a term that half of all documents hold is thus spread over all
   tasks). Document frequencies and lengths are summed up over the shards.
2. Every list sends its heads, its k highest impacts over all shards. Their partial sums give each
   item a lower bound t: the k-th highest partial sum.
3. Of every list of an item, all postings that score at least t / (number of its lists) are
   fetched. A document that no list fetches scores less than t. What is fetched is summed up; a
   document stays a candidate if its sum, with the most that the other lists could add, reaches the
   bound; and the scores of candidates are completed by looking them up in the other lists.
   As the postings of a document are all in its shard, this round needs no shuffle; each task sends
   k documents of each item, of which the k best stay.

Items are taken in blocks of ITEM_TERMS terms at most (one item at least), so that what tasks hold
of them is bounded; every block sees all documents. The lists are written to the shared folder once
for each block.

Defined cases: a null text, or one without a term, matches nothing and does not count as a document. A null doc_id
comes last among equal scores; rows that share a doc_id are ranked each by itself. Equal items (id
and text) count once; the texts of different ones that share an id are one item together; a null id
is an item too. An item whose terms no document holds has no rows. Texts are read whole. Columns other than ids
and texts, whatever their names, are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import checkpointed
from .words import slices

#: Bytes of text whose postings make a shard, and terms of items that tasks hold at once.
SHARD_BYTES, ITEM_TERMS = 4 << 20, 200_000
#: What separates terms, and the constants of the score.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UNIT, SHIFT, WEIGHT, LENGTH_SHARE, LENGTH_UNIT = 1_000_000_000, 1000, 8, 75, 100

SHARD = "ids array<long>, lengths binary, codes array<int>, counts array<int>, docs binary, tfs binary, n long, total long"


def _bytes_of_terms() -> np.ndarray:
    """What each byte becomes: A-Z their small letters, separators a space."""
    b = np.arange(256)
    letter = ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x61) & (b <= 0x7A)) | ((b >= 0x41) & (b <= 0x5A)) | (b >= 0x80)
    return np.where(letter, np.where((b >= 0x41) & (b <= 0x5A), b + 32, b), 0x20).astype(np.uint8)


_TABLE = _bytes_of_terms()


def terms_of(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower()), SEPARATORS), lambda t: t != "")


def _count(column: pa.Array, vocabulary: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: first row, terms of each text, and (row, code, occurrences) of asked terms."""
    for first, data, offsets in slices(column):
        n = len(offsets) - 1
        text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_TABLE[data])])
        found = pc.ascii_split_whitespace(text)
        flat = found.flatten()
        real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n), pc.list_value_length(found).to_numpy(zero_copy_only=False))
        lengths = np.bincount(row[real], minlength=n)
        codes = pc.index_in(flat, vocabulary)
        asked = codes.is_valid().to_numpy(zero_copy_only=False)
        key = row[asked] * len(vocabulary) + codes.drop_null().to_numpy()
        key, tf = np.unique(key, return_counts=True)
        yield first, lengths, key // len(vocabulary), key % len(vocabulary), tf


def _sharding(vocabulary: list[str]):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(vocabulary, pa.large_string())
        kept: list = []  # ids, lengths, row, code, tf
        size = rows = 0

        def flush():
            ids = pa.concat_arrays([k[0] for k in kept])
            lengths, row, code, tf = (np.concatenate([k[i] for k in kept]) for i in range(1, 5))
            order = np.lexsort((row, code))
            codes, counts = np.unique(code, return_counts=True)
            return pa.record_batch({
                "ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([lengths.astype(np.int64).tobytes()], pa.binary()),
                "codes": pa.array([codes.astype(np.int32)], pa.list_(pa.int32())), "counts": pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                "docs": pa.array([row[order].astype(np.int32).tobytes()], pa.binary()), "tfs": pa.array([tf[order].astype(np.int32).tobytes()], pa.binary()),
                "n": pa.array([int((lengths > 0).sum())], pa.int64()), "total": pa.array([int(lengths.sum())], pa.int64()),
            })

        for batch in batches:
            ids = batch.column("doc_id")
            for first, lengths, row, code, tf in _count(batch.column("text"), asked):
                kept.append((ids.slice(first, len(lengths)), lengths, row + rows, code, tf))
                rows += len(lengths)
                size += int(lengths.sum()) * 6 + 16 * len(lengths)
                if size >= SHARD_BYTES:
                    yield flush()
                    kept, size, rows = [], 0, 0
        if kept:
            yield flush()

    return shards


def _lists(batch: pa.RecordBatch, n: int, total: int):
    """Of each shard: ids (void ones marked), codes, edges of the lists, documents and impacts of their postings."""
    for i in range(batch.num_rows):
        ids = batch.column("ids")[i].values
        void = ids.is_null().to_numpy(zero_copy_only=False)
        length = np.frombuffer(batch.column("lengths")[i].as_buffer(), np.int64)
        codes = batch.column("codes")[i].values.to_numpy()
        edges = np.concatenate([[0], np.cumsum(batch.column("counts")[i].values.to_numpy().astype(np.int64))])
        docs = np.frombuffer(batch.column("docs")[i].as_buffer(), np.int32)
        tf = np.frombuffer(batch.column("tfs")[i].as_buffer(), np.int32).astype(np.int64)
        m = LENGTH_UNIT - LENGTH_SHARE + LENGTH_SHARE * length * n // max(total, 1)
        yield ids.fill_null(0).to_numpy(), void, codes, edges, docs, UNIT * tf // (SHIFT * tf + WEIGHT * m[docs])


def _best(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, void: np.ndarray, k: int):
    """The k highest scores of each group, equal ones by id, void ids last."""
    order = np.lexsort((ids, void, -scores, groups))
    groups, scores, ids, void = groups[order], scores[order], ids[order], void[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1]) if len(groups) else np.zeros(0, np.int64)
    nth = np.arange(len(groups)) - np.repeat(start, np.diff(np.append(start, len(groups))))
    top = nth < k
    return groups[top], scores[top], ids[top], void[top]


class _Kept:
    """The best rows of a task so far; cut down whenever they have doubled."""

    def __init__(self, k: int):
        self.k, self.parts, self.rows, self.after = k, [], 0, 0

    def add(self, groups, scores, ids, void):
        self.parts.append((groups, scores, ids, void))
        self.rows += len(groups)
        if self.rows > 2 * self.after + 100_000:
            self.cut()

    def cut(self):
        if self.parts:
            self.parts = [_best(*(np.concatenate(x) for x in zip(*self.parts, strict=True)), self.k)]
            self.rows = self.after = len(self.parts[0][0])
        return self.parts[0] if self.parts else None

    def batch(self, name: str, id_name: str) -> Iterator[pa.RecordBatch]:
        if (got := self.cut()) is not None:
            groups, scores, ids, void = got
            yield pa.record_batch({name: groups.astype(np.int32), "score": scores, id_name: pa.array(ids, pa.int64(), mask=void)})


def _heads(n: int, total: int, k: int):
    def run(batches):
        kept, before = _Kept(k), 0
        for batch in batches:
            for ids, _, codes, edges, docs, impact in _lists(batch, n, total):
                kept.add(*_best(np.repeat(codes, np.diff(edges)), impact, before + docs.astype(np.int64), np.zeros(len(docs), bool), k))
                before += len(ids)
        yield from kept.batch("code", "place")

    return run


def fetch(lists: list[tuple[int, np.ndarray, np.ndarray]], bound: int, n_lists: int, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard that may be among the k best of an item, and their exact scores.

    lists: weight, documents (ascending) and impacts of each list; bound: k documents score as much.
    """
    least = -(-bound // n_lists)  # what a posting must score to be fetched
    score, seen = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int32)
    left = []
    for weight, docs, impact in lists:
        gain = weight * impact
        take = gain >= least
        if take.all():
            score[docs] += gain
            seen[docs] += 1
        else:
            score[docs[take]] += gain[take]
            seen[docs[take]] += 1
            left.append((docs[~take], gain[~take]))
    found = np.flatnonzero(seen)
    if len(found) > k:
        bound = max(bound, int(np.partition(score[found], len(found) - k)[len(found) - k]))
    candidates = found[score[found] + (n_lists - seen[found]).astype(np.int64) * max(least - 1, 0) >= bound]
    wanted = np.zeros(n_docs, bool)
    wanted[candidates] = True
    for docs, gain in left:
        hit = wanted[docs]
        score[docs[hit]] += gain[hit]
    return candidates, score[candidates]


def _search(asked: list[tuple[int, int, list[tuple[int, int]]]], n: int, total: int, k: int):
    """asked: key, bound and (code, weight) of the lists of each item."""

    def run(batches):
        kept = _Kept(k)
        for batch in batches:
            for ids, void, codes, edges, docs, impact in _lists(batch, n, total):
                own = {int(c): (docs[a:b], impact[a:b]) for c, a, b in zip(codes, edges[:-1], edges[1:], strict=True)}
                for key, bound, weights in asked:
                    lists = [(w, *own[c]) for c, w in weights if c in own]
                    if lists:
                        at, score = fetch(lists, bound, len(weights), len(ids), k)
                        kept.add(*_best(np.full(len(at), key), score, ids[at], void[at], k))
        yield from kept.batch("key", "doc_id")

    return run


def _block(docs: DataFrame, own: list, k: int) -> DataFrame:
    """Rows (item_id, doc_id, score, rank) of a block of items: item_id and {term: occurrences} of each."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, counts in own for t in counts})
    code = {t: i for i, t in enumerate(vocabulary)}
    shards = checkpointed(docs.mapInArrow(_sharding(vocabulary), SHARD))
    n, total = (int(x or 0) for x in shards.agg(F.sum("n"), F.sum("total")).first())
    each = shards.select(F.explode(F.arrays_zip("codes", "counts")).alias("c")).groupBy(F.col("c.codes").alias("code")).agg(F.sum("c.counts").alias("df"))
    weight = {r.code: r.w for r in each.select("code", F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")).collect()}
    lists = [[(code[t], c * weight[code[t]]) for t, c in sorted(counts.items()) if weight.get(code[t], 0) > 0] for _, counts in own]
    asked = spark.createDataFrame([(i, c, w) for i, ws in enumerate(lists) for c, w in ws], "key int, code int, weight long")
    # the bound of each item, from the heads of its lists; a document is told by its place, as ids may repeat
    head = Window.partitionBy("code").orderBy(F.desc("score"), "part", "place")
    heads = shards.mapInArrow(_heads(n, total, k), "code int, score long, place long").withColumn("part", F.spark_partition_id())
    heads = heads.withColumn("nth", F.row_number().over(head)).where(F.col("nth") <= k)
    sums = heads.join(F.broadcast(asked), "code").groupBy("key", "part", "place").agg(F.sum(F.col("weight") * F.col("score")).alias("s"))
    best = Window.partitionBy("key").orderBy(F.desc("s"))
    bound = {r.key: r.s for r in sums.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select("key", "s").collect()}
    todo = [(i, bound.get(i, 0), ws) for i, ws in enumerate(lists) if ws]
    found = shards.mapInArrow(_search(todo, n, total, k), "key int, score long, doc_id long").where("score > 0")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(own)], "key int, item_id long")
    return ranked.join(F.broadcast(names), "key").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score (long) of the k documents (doc_id, text) that score highest for each item (item_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    asked = asked.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))
    each = checkpointed(asked.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "n"))).alias("terms")))
    size = each.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-size // ITEM_TERMS)
    out = None
    for b in range(blocks):
        own = each.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = [(r.item_id, {t.term: t.n for t in r.terms}) for r in own.orderBy("item_id").toLocalIterator()]
        if rows:
            part = _block(docs, rows, k)
            out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS n_asked FROM i GROUP BY item_id, term),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_all FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, term, max(len)::BIGINT AS n, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * max(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
r AS (SELECT item_id, doc_id, sum(n_asked * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_all))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
