"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of distinct shingles. An item's signature is the least
hashes of its shingles, as many as its size class may miss and one more: a document that holds
the asked share of an item then holds at least one hash of its signature, so the search loses
nothing. Documents of any length probe the signatures with the hashes of all their shingles.
What is found is verified by exact containment: the shingles of the documents found, as texts,
are matched with those of the items, and matches are counted. Column expressions only: no
Python runs on the executors. Texts stay where they are: only matches are shuffled.

Signatures, item shingles and found documents are broadcast where their number, which is counted,
is at most BROADCAST_ROWS; beyond it hashes are shuffled, and all documents are verified.

Defined cases: null and blank texts have no shingles and match nothing; a text of fewer words
than a shingle has is one shingle, and very long texts are read whole. Equal documents (id and
text) count as one, and so do equal items. A null id is kept as one. Columns other than the ids
and texts, whatever their names, are not read. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed

#: Rows that may be broadcast: signature hashes, item shingles, found documents.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased words: runs without U+0020 and U+0009-U+000D."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(n: Column, k: int) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - F.lit(k - 1), F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))


def shingle_hashes(text: Column, k: int) -> Column:
    return let(words(text), lambda own: F.array_distinct(F.transform(_places(F.size(own), k), lambda i: F.xxhash64(F.slice(own, i, k)))))


def shingle_texts(text: Column, k: int) -> Column:
    return let(words(text), lambda own: F.array_distinct(F.transform(_places(F.size(own), k), lambda i: F.array_join(F.slice(own, i, k), " "))))


def signatures(items: DataFrame, k: int, percent: int) -> DataFrame:
    """(item_id, item_text, n, sig): sig has the least hashes of the item, by its size class."""
    own = items.select(F.col("item_id"), F.col("text").alias("item_text"), F.array_sort(shingle_hashes(F.col("text"), k)).alias("h"))
    own = own.where(F.size("h") > 0).withColumn("n", F.size("h"))
    upper = F.pow(F.lit(2), F.ceil(F.log2("n")))  # of the size class: powers of two
    may_miss = (upper - F.ceil(upper * percent / 100)).cast("int")
    return own.select("item_id", "item_text", "n", F.slice("h", F.lit(1), F.least(F.col("n"), may_miss + 1)).alias("sig"))


def small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast where they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, item_id, n_shared and n_item of each item of whose shingles a document has at least `percent` in a hundred."""
    return _contained(docs, items, k, percent).drop("doc")


def _contained(docs: DataFrame, items: DataFrame, k: int, percent: int) -> DataFrame:
    text = F.col("text").cast("string")
    # rows are told apart by their texts, as ids may be null or occur twice
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("doc"), text.alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.col("item_id").cast("long"), text).alias("item"), text.alias("text")).distinct()
    sig = signatures(items.select(F.struct("item_id", "item").alias("item_id"), "text"), k, percent).select("item_id.item_id", "item_id.item", "item_text", "n", "sig")
    keys = small(sig.select("item", F.explode("sig").alias("h")).distinct())
    probes = docs.select("doc", F.explode(shingle_hashes(F.col("text"), k)).alias("h"))
    found = checkpointed(probes.join(keys, "h").select("doc", "item").distinct())
    # exact containment of what was found
    asked = found.select("doc").distinct()
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    suspects = docs.join(F.broadcast(asked), "doc", "left_semi") if few else docs
    held = small(sig.select("item", F.explode(shingle_texts(F.col("item_text"), k)).alias("s")))
    hits = suspects.select("doc_id", "doc", F.explode(shingle_texts(F.col("text"), k)).alias("s")).join(held, "s")
    shared = hits.groupBy("doc_id", "doc", "item", F.xxhash64("s").alias("h")).agg(F.lit(1).alias("one")).groupBy("doc_id", "doc", "item").agg(F.count(F.lit(1)).alias("n_shared"))
    exact = shared.join(found, ["doc", "item"]).join(small(sig.select("item", "item_id", F.col("n").cast("long").alias("n_item"))), "item")
    return exact.select("doc_id", "doc", "item_id", "n_shared", "n_item").where(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def clean_documents(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, that hold no item. Rows that share an id, or have none, are judged by their own texts."""
    leaks = small(checkpointed(_contained(docs, items, k, percent).select("doc").distinct()))
    own = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), own.alias("doc"))
    return rows.join(leaks, "doc", "left_anti").select("row.*")


ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM dw WHERE len(w) > 0),
its AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n_item)::BIGINT AS n_item
FROM ds JOIN its USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) * 100 >= any_value(n_item) * 75
"""
