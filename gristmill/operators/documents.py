"""Raw articles to documents: cleaned text, metadata, the reason of a rejection, first of each id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions.entities import unescape_all
from ..functions.text import assemble
from . import metadata as M


def reject_reason(text: Column, external_id: Column, url: Column) -> Column:
    """The first rule that fails: text, external_id, url; null if none does."""
    return F.when(F.coalesce(C.strip(text), F.lit("")) == "", F.lit("text")).when(F.coalesce(external_id, F.lit("")) == "", F.lit("external_id")).when(F.coalesce(C.strip(url), F.lit("")) == "", F.lit("url"))


def transform(raw: DataFrame, mode: str = "permissive", sites: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """raw: pos, doc (VARIANT). Returns pos, text, metadata, reject_reason and shape_warnings of every row, and the columns in keep as they are."""
    if mode not in ("permissive", "strict"):
        raise ValueError(f"mode must be permissive or strict, not {mode!r}")
    doc = F.col("doc")
    # a generator keeps the optimiser from inlining the parsing of doc into each of its many uses
    raw = raw.select("pos", *keep, F.explode(F.array("doc")).alias("doc"))
    rows = raw.select("pos", *keep, "doc", M.website(doc).alias("website"), M.fragments(doc).alias("fragments"))
    rows = rows.withColumns({"site": M.site_data(doc, F.col("website")), "base": M.base_url(F.col("website"), sites), "published": M.publish_date(doc)})
    problems = M.shape_problems(doc, F.col("site"))
    rows = rows.withColumn("problems", problems)
    rows = rows.withColumn("text", assemble(unescape_all(F.col("fragments"))))
    base, site, published = F.col("base"), F.col("site"), F.col("published")
    own = {
        "external_id": M.external_id(doc),
        "url": M.url(doc, site, base),
        "sections": M.sections(doc, site),
        "categories": M.categories(doc),
        "tags": M.tags(doc),
        "title": M.title(doc),
        "website": F.col("website"),
        "publish_date": published,
        "datetime": M.dated(doc, "datetime", published),
        "first_publish_date": M.dated(doc, "first_publish_date", published),
        "thumb": M.thumb(doc, base),
    }
    rows = rows.select("pos", *keep, "text", F.struct(*(own[f].alias(f) for f in M.FIELDS)).alias("metadata"), "problems")
    if mode == "strict":
        message = F.concat(F.lit("unexpected shape at pos "), F.col("pos").cast("string"), F.lit(": "), F.array_join("problems", ", "))
        rows = rows.withColumn("problems", F.when(F.size("problems") > 0, F.raise_error(message).cast("array<string>")).otherwise(F.col("problems")))
    reason = reject_reason(F.col("text"), F.col("metadata.external_id"), F.col("metadata.url"))
    return rows.select("pos", "text", "metadata", reason.alias("reject_reason"), F.col("problems").alias("shape_warnings"), *keep)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason IS NULL").select("pos", "text", "metadata")


def rejects(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason IS NOT NULL").select("pos", "reject_reason", "text", "metadata")


def keep_first(rows: DataFrame, key: str = "metadata.external_id", order: str = "pos") -> DataFrame:
    """The first row of each key in input order; rows without a key all stay. One pass and one shuffle, cut down before it.

    Rows without a key are dealt by their order, so that they do not meet in one task.
    """
    alone = F.when(F.col(key).isNull(), F.col(order))
    own = Window.partitionBy(F.col(key), alone).orderBy(F.col(order))
    nth = "__nth_of_key"
    return rows.withColumn(nth, F.row_number().over(own)).where(F.col(key).isNull() | (F.col(nth) == 1)).drop(nth)


def counters(rows: DataFrame) -> DataFrame:
    """One row: total, kept, skipped, duplicates; ids are counted, not gathered."""
    id_ = F.when(F.col("reject_reason").isNull(), F.col("metadata.external_id"))
    one = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("reject_reason").isNull()).alias("valid"), F.count_distinct(id_).alias("kept"))
    return one.select("total", "kept", (F.col("total") - F.col("valid")).alias("skipped"), (F.col("valid") - F.col("kept")).alias("duplicates"))


def points(docs: DataFrame, vector: Column) -> DataFrame:
    """pos, id, vector, payload: the text and every metadata field at one level."""
    payload = F.struct(F.col("text"), *(F.col("metadata." + f).alias(f) for f in M.FIELDS))
    return docs.where(F.coalesce(F.col("metadata.external_id"), F.lit("")) != "").select("pos", F.col("metadata.external_id").alias("id"), vector.alias("vector"), payload.alias("payload"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The newest version of every key; both sides have the same columns."""
    own = Window.partitionBy(key).orderBy(F.col(version).desc())
    return old.unionByName(new).withColumn("__newest", F.row_number().over(own)).where("__newest = 1").drop("__newest")


def expired(runs: DataFrame, order: str, keep_last: int = 10, by: list[str] | None = None) -> DataFrame:
    """Runs beyond the newest keep_last (of each group, if any)."""
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return runs.withColumn("__age", F.row_number().over(own.orderBy(F.col(order).desc()))).where(F.col("__age") > keep_last).drop("__age")
