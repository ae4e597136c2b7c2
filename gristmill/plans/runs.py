"""Driver queries of sources, sinks, stored state and whole runs: what is written is read back and held against the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce as C
from ..operators import collection
from ..operators import embed as E
from ..operators import metadata as M
from ..operators.similarity import nearest
from ..operators.vector_index import build
from ..operators.vector_store import VectorStore
from ..sources import arrays, files, sinks
from ..sources import points as P
from ..sources.documents import chosen_list, read_lines
from ..sources.store import Store
from ..streaming import ingest as stream
from . import ingest
from .registry import ORACLES as ORACLES
from .registry import QUERIES as QUERIES
from .registry import _articles, query, table, variant


@query("SELECT doc_id, text, n_chars FROM documents WHERE text IS NOT NULL")
def json_lines_round_trip(spark, sf):
    """The native sink and the scan of JSON lines, through the shared folder."""
    folder = files.scratch(spark, "lines")
    sinks.write_lines(table(spark, sf, "documents").select("doc_id", "text", "n_chars").where("text IS NOT NULL"), folder)
    doc = F.col("doc")
    return read_lines(spark, folder).select(F.try_variant_get(doc, "$.doc_id", "long").alias("doc_id"), C.to_str(C.child(doc, "text")).alias("text"), F.try_variant_get(doc, "$.n_chars", "long").alias("n_chars"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, text, source FROM documents")
def array_round_trip(spark, sf):
    """The array sink, in the order of the ids, and the scan of one array by all tasks."""
    path = f"{files.scratch(spark, 'array')}/documents.json"
    sinks.export_array(table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "doc_id", "text", "source"), path)
    doc = F.col("doc")
    return arrays.read_array(spark, path).select("pos", F.try_variant_get(doc, "$.doc_id", "long").alias("doc_id"), C.to_str(C.child(doc, "text")).alias("text"), C.to_str(C.child(doc, "source")).alias("source"))


@query("SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 4) AS total, len(embedding)::BIGINT AS dim, label::VARCHAR AS text FROM embeddings")
def point_array_round_trip(spark, sf):
    """Points as one array, written and read by all tasks."""
    path = f"{files.scratch(spark, 'points')}/points.json"
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.struct(F.col("label").cast("string").alias("text")).alias("payload"))
    sinks.export_array(rows, path)
    points = P.from_chunks(arrays.read_chunks(spark, path))
    numbers = F.try_variant_get("vector", "$", "array<double>")
    total = F.round(F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x), 4)
    return points.select(F.try_variant_get("id", "$", "long").alias("id"), total.alias("total"), F.size(numbers).cast("long").alias("dim"), C.to_str(C.child(F.col("payload"), "text")).alias("text"))


@query("SELECT vec_id AS id, len(embedding)::BIGINT AS dim FROM embeddings")
def point_lines_round_trip(spark, sf):
    folder = files.scratch(spark, "point-lines")
    sinks.write_lines(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.struct(F.col("vec_id").cast("string").alias("text")).alias("payload")), folder)
    return P.read_point_lines(spark, folder).select(F.try_variant_get("id", "$", "long").alias("id"), F.size(F.try_variant_get("vector", "$", "array<double>")).cast("long").alias("dim"))


@query("""
SELECT doc_id AS key, 'kept' AS outcome, text FROM documents WHERE text IS NOT NULL
UNION ALL SELECT page_id, 'malformed', '{' || url FROM pages WHERE url IS NOT NULL""")
def quarantined_lines(spark, sf):
    """Lines of which some are no JSON: those go aside, with their text; the others are read.

    A line tells its text only, so pages of the same address are told apart by number: all of them, if as many
    lines of this text went aside as were written; both sides are counted before they meet.
    """
    folder = f"{files.scratch(spark, 'broken')}/lines"
    good = table(spark, sf, "documents").where("text IS NOT NULL").select(F.to_json(F.struct("doc_id", "text")).alias("value"))
    bad = table(spark, sf, "pages").where("url IS NOT NULL").select(F.concat(F.lit("{"), "url").alias("value"), "page_id")
    good.unionAll(bad.select("value")).write.text(folder)
    rows, doc = read_lines(spark, folder, "permissive"), F.col("doc")
    kept = rows.where("broken IS NULL").select(F.try_variant_get(doc, "$.doc_id", "long").alias("key"), F.lit("kept").alias("outcome"), C.to_str(C.child(doc, "text")).alias("text"))
    aside = rows.where("broken IS NOT NULL").groupBy(F.col("broken.text").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    whole = aside.join(bad.groupBy(F.col("value").alias("text")).agg(F.count(F.lit(1)).alias("n")), ["text", "n"])
    return kept.unionByName(bad.join(whole, bad.value == whole.text).select(F.col("page_id").alias("key"), F.lit("malformed").alias("outcome"), "text"))


@query("""
SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN 0 ELSE 1 END::BIGINT AS n, CASE WHEN turn % 4 <> 3 THEN text END AS text FROM conversations""")
def wrapped_scan(spark, sf):
    """The list that a source value holds: itself, its documents, else its results, else nothing."""
    k, one = F.col("turn") % 4, F.array(F.struct("text"))
    wrapped = F.when(k == 0, F.to_json(one)).when(k == 1, F.to_json(F.struct(one.alias("documents"), F.lit(1).alias("results")))).when(k == 2, F.to_json(F.struct(F.array().alias("documents"), one.alias("results")))).otherwise('{"documents": null, "results": {"a": 1}}')
    rows = table(spark, sf, "conversations").select("conv_id", "turn", chosen_list(F.parse_json(wrapped)).alias("docs"))
    return rows.select("conv_id", "turn", F.size("docs").cast("long").alias("n"), C.to_str(C.child(F.get("docs", 0), "text")).alias("text"))


@query("""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'headlines' WHEN 2 THEN 'taxonomy.tags' WHEN 3 THEN 'content_elements,content_elements.content' ELSE 'additional_properties' END AS problems FROM documents""")
def shape_warnings(spark, sf):
    """Odd shapes that a permissive run names and takes as absent."""
    k = F.col("doc_id") % 5
    odd = lambda i, name, value: F.when(k == i, value).alias(name)
    doc = F.parse_json(F.when(k == 3, F.concat(F.lit('{"content_elements": [7, {"type": "text", "content": ["'), "source", F.lit('"]}]}'))).otherwise(F.to_json(F.struct(odd(1, "headlines", F.col("lang")), F.when(k == 2, F.struct(F.array("lang").alias("tags"))).alias("taxonomy"), odd(4, "additional_properties", F.array("source"))))))
    rows = table(spark, sf, "documents").select("doc_id", doc.alias("doc"))
    return rows.select("doc_id", F.array_join(M.shape_problems(F.col("doc"), F.lit(None).cast("variant")), ",").alias("problems"))


def _measured(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("a"))] for t in texts]


@query("SELECT doc_id, least(length(text), 300)::DOUBLE AS chars, (length(text[:300]) - length(replace(text[:300], 'a', '')))::DOUBLE AS n_a FROM documents WHERE text IS NOT NULL AND strpos(reverse(text[:300]), ' ') = 0 OR length(text) <= 300")
def embed_texts(spark, sf):
    """Vectors of an embedder on the executors, in batches; texts that are not cut at a word."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL AND NOT contains(left(text, 300), ' ') OR length(text) <= 300")
    rows = E.attach_vectors(docs.select("doc_id", "text"), _measured, batch=7, max_chars=300)
    return rows.select("doc_id", F.col("vector")[0].cast("double").alias("chars"), F.col("vector")[1].cast("double").alias("n_a"))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_custkey IS NOT NULL) WHERE n = 1""")
def bucketed_upsert(spark, sf):
    """The newest order of each customer, from a stored table that takes the orders in three merges, and drops old snapshots."""
    version = F.concat_ws("/", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0"))
    rows = table(spark, sf, "orders").where("o_custkey IS NOT NULL").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", version.alias("version"))
    store = Store(spark, files.scratch(spark, "store")).create(rows.drop("o_orderstatus").schema, "o_custkey", "version", 16)
    for part in (F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", ~F.coalesce(F.col("o_orderstatus"), F.lit("")).isin("F", "O")):
        store.merge(rows.where(part))
    store.retain(1, grace=0)
    return store.read().drop("version")


@query("""
WITH a AS (SELECT doc_id AS pos, doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 AS bad, doc_id % 400 AS id FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY bad, id ORDER BY pos) AS n FROM a)
SELECT (SELECT count(*) FROM a)::BIGINT AS total_raw, count(*) FILTER (WHERE NOT bad AND n = 1)::BIGINT AS processed, count(*) FILTER (WHERE bad)::BIGINT AS skipped, count(*) FILTER (WHERE NOT bad AND n > 1)::BIGINT AS duplicates_removed FROM n""")
def run_metadata(spark, sf):
    """A whole native run over JSON lines: what it says of itself."""
    folder = files.scratch(spark, "run")
    _articles(spark, sf).select(F.to_json("doc").alias("value")).write.text(f"{folder}/in")
    ingest.run_pipeline(spark, f"{folder}/in", f"{folder}/out", native=True, lines=True, skip_embeddings=True, rejects=True)
    fs, out = files.at(spark, f"{folder}/out")
    (name,) = (f.getPath().toString() for f in files.listed(fs, out) if f.getPath().getName().startswith(sinks.METADATA))
    fields = ("total_raw", "processed", "skipped", "duplicates_removed")
    return spark.read.text(name, wholetext=True).select(F.parse_json("value").alias("v")).select(*(F.try_variant_get("v", f"$.{f}", "long").alias(f) for f in fields))


@query("SELECT count(*) FILTER (WHERE vec_id % 100 = 0)::BIGINT AS n_queries, TRUE AS recall_reached FROM embeddings")
def indexed_topk(spark, sf):
    """The ten nearest vectors of the stated query set (ids divisible by 100) by the index: whether nine tenths of the true ones are found."""
    vectors = table(spark, sf, "embeddings")
    queries = vectors.where("vec_id % 100 = 0")
    index = build(vectors, f"{files.scratch(spark, 'index')}/cells", "vec_id", "embedding", ("label",))
    got = index.search(queries.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), 10).select(F.col("q").alias("vec_id"), "neighbour", F.lit(1).alias("hit"))
    true = nearest(queries, vectors, 10).select("vec_id", "neighbour")
    share = F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)) >= 0.9
    return true.join(got, ["vec_id", "neighbour"], "left").agg(F.count_distinct("vec_id").alias("n_queries"), share.alias("recall_reached"))


@query("""
WITH o AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS step FROM orders WHERE o_custkey IS NOT NULL)
SELECT v::BIGINT AS version, count(DISTINCT o_custkey)::BIGINT AS n_keys, max(o_orderkey)::BIGINT AS last_key
FROM (SELECT unnest([1, 2, 3]) AS v) JOIN o ON step <= v GROUP BY v""")
def stored_versions(spark, sf):
    """What each snapshot of a stored table holds, after three merges that keep the greatest order of a customer."""
    rows = table(spark, sf, "orders").where("o_custkey IS NOT NULL").select("o_custkey", "o_orderkey", "o_orderstatus")
    store = Store(spark, files.scratch(spark, "versions")).create(rows.drop("o_orderstatus").schema, "o_custkey", "o_orderkey", 16)
    status = F.coalesce(F.col("o_orderstatus"), F.lit(""))
    out = None
    for part in (status == "F", status == "O", ~status.isin("F", "O")):
        number = store.merge(rows.where(part))
        one = store.read(number).agg(F.lit(number).cast("long").alias("version"), F.count(F.lit(1)).alias("n_keys"), F.max("o_orderkey").alias("last_key"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT count(*)::BIGINT AS total_raw, count(DISTINCT doc_id % 400) FILTER (WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0)::BIGINT AS processed, 0::BIGINT AS n_written FROM documents")
def dry_run(spark, sf):
    """A run that only counts."""
    folder = files.scratch(spark, "dry")
    _articles(spark, sf).select(F.to_json("doc").alias("value")).write.text(f"{folder}/in")
    total, kept, paths = ingest.run_pipeline(spark, f"{folder}/in", f"{folder}/out", dry_run=True, lines=True)
    left = files.listed(*files.at(spark, f"{folder}/out"))
    return spark.createDataFrame([(total, kept, len(left) + len(paths))], "total_raw long, processed long, n_written long")


@query("""
WITH a AS (SELECT doc_id, text, doc_id % 400 AS id FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0)
SELECT 'a' || id AS id, url FROM (SELECT id, CASE WHEN doc_id % 2 = 0 THEN 'https://www.nj.com' ELSE '' END || '/x/' || doc_id AS url, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS n FROM a) WHERE n = 1""")
def stream_keep_first(spark, sf):
    """The stream over files of articles in the order of their ids, in three micro-batches or so."""
    folder = files.scratch(spark, "stream")
    articles = _articles(spark, sf).repartitionByRange(6, "pos").sortWithinPartitions("pos")
    articles.select(F.to_json("doc").alias("value")).write.text(f"{folder}/in")
    rows = stream.documents(stream.read_stream(spark, f"{folder}/in", 2))
    query_ = stream.start(rows, stream.batch_sink(f"{folder}/out"), f"{folder}/checkpoint")
    query_.awaitTermination()
    return stream.documents_of(spark, f"{folder}/out").select("id", "metadata.url")


@query("""
SELECT doc_id AS pos, 'd' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS title, CASE WHEN doc_id % 3 = 0 THEN 'c' ELSE 'p' END AS published_at, 8::BIGINT AS dim FROM documents""")
def sketched_points(spark, sf):
    """The records and points as first sketched."""
    k = F.col("doc_id")
    headlines = F.when(k % 2 == 0, F.struct(F.col("lang").alias("basic")))
    doc = variant(F.concat(F.lit("d"), k.cast("string")).alias("id"), headlines.alias("headlines"), F.when(k % 2 == 1, F.col("source")).alias("title"), F.lit("u").alias("canonical_url"), F.when(k % 3 != 0, "p").alias("publish_date"), F.lit("c").alias("created_date"))
    records = collection.internal_documents(table(spark, sf, "documents").select(k.alias("pos"), doc.alias("doc")))
    points = collection.sketched_points(records, F.array_repeat(F.lit(0.0), 8))
    return points.select("pos", "id", "payload.title", "payload.published_at", F.size("vector").cast("long").alias("dim"))


@query("SELECT doc_id, least(length(text), 300)::DOUBLE AS chars FROM documents WHERE length(text) <= 300")
def stored_vectors(spark, sf):
    """Vectors of a store that has seen half of the texts before."""
    docs = table(spark, sf, "documents").where("length(text) <= 300").select("doc_id", "text", "lang")
    store = VectorStore(spark, files.scratch(spark, "vectors"), 8)
    store.attach(docs.where("lang <= 'en'"), _measured, max_chars=300)
    return store.attach(docs, _measured, max_chars=300).select("doc_id", F.col("vector")[0].cast("double").alias("chars"))
