"""Design of the vector collection, and the plain article record; neither is on the path of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as C

#: The collection that points are meant for.
COLLECTION = {"name": "news_articles", "size": 1536, "distance": "Cosine", "indexed": ("external_id", "website", "sections", "publish_date"), "primary_key": "external_id"}


def internal_documents(raw: DataFrame) -> DataFrame:
    """raw: pos, doc. The record as first sketched: id before _id, no text, no categories, no thumbnail yet."""
    doc = F.col("doc")
    headlines = C.child(doc, "headlines")
    return raw.select(
        "pos",
        F.coalesce(C.to_str(C.first_truthy(C.child(doc, "id"), C.child(doc, "_id"), F.parse_json(F.lit('""')))), F.lit("")).alias("external_id"),
        C.to_str(F.when(C.is_object(headlines), C.child(doc, "headlines.basic")).otherwise(C.child(doc, "title"))).alias("title"),
        C.to_str(C.child(doc, "canonical_url")).alias("url"),
        C.to_str(C.first_truthy(C.child(doc, "publish_date"), C.child(doc, "created_date"))).alias("published_at"),
        C.no_strings().alias("categories"),
        F.lit(None).cast("string").alias("thumbnail_url"),
        F.lit("").alias("text"),
        doc.alias("original"),
    )


def sketched_points(records: DataFrame, vector: Column) -> DataFrame:
    """pos, id, vector, payload of records of internal_documents, the original left out."""
    fields = ("external_id", "title", "url", "published_at", "categories", "thumbnail_url", "text")
    return records.select("pos", F.col("external_id").alias("id"), vector.alias("vector"), F.struct(*fields).alias("payload"))
