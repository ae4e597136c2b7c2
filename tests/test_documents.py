"""Articles to documents: fallbacks, rejections, hazards, first of each id."""

import json

import pytest
from gristmill.operators import documents as D
from pyspark.sql import functions as F


def article(**own):
    base = {"_id": "a", "title": "T", "url": "u", "website": "nj", "content_elements": [{"type": "text", "content": "<p>Hello &amp; <b>world</b></p>"}, {"type": "image", "content": "x"}]}
    return {k: v for k, v in (base | own).items() if v != "DROP"}


def rows(spark, docs, mode="permissive"):
    raw = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "pos long, j string").select("pos", F.parse_json("j").alias("doc"))
    return D.transform(raw, mode)


def one(spark, **own):
    return rows(spark, [article(**own)]).first()


def metas(spark, *cases):
    return [r.metadata for r in rows(spark, [article(**c) for c in cases]).orderBy("pos").collect()]


def test_text_and_required_fields(spark):
    r = one(spark)
    assert (r.text, r.metadata.external_id, r.metadata.url, r.metadata.title, r.reject_reason) == ("Hello & world", "a", "u", "T", None)
    assert (r.metadata.sections, r.metadata.tags, r.metadata.categories) == ([], [], [])


def test_rejections_in_order(spark):
    blank = [{"type": "text", "content": "  "}]
    cases = [{"content_elements": []}, {"content_elements": blank}, {"content_elements": None}, {"_id": ""}, {"_id": None}, {"url": "  "}, {"url": "DROP"}, {"content_elements": blank, "_id": "", "url": ""}, {}]
    got = [r.reject_reason for r in rows(spark, [article(**c) for c in cases]).orderBy("pos").collect()]
    assert got == ["text", "text", "text", "external_id", "external_id", "url", "url", "text", None]


def test_ids(spark):
    got = metas(spark, {"_id": 7}, {"_id": 0, "id": 0}, {"_id": " x "}, {"_id": " "}, {"_id": "DROP", "external_id": "e"}, {"_id": "", "id": True})
    assert [m.external_id for m in got] == ["7", "0", " x ", " ", "e", "True"]


def test_blank_first_choice_blocks_fallbacks(spark):
    a, b = metas(spark, {"headlines": {"basic": "  "}, "title": "X"}, {"headlines": {"basic": ""}, "headline": "H"})
    assert (a.title, b.title) == (None, "H")


def test_addresses(spark):
    site = {"nj": {"website_url": "/w"}}
    got = metas(spark, {"url": "DROP", "websites": site}, {"url": "DROP", "canonical_url": "/c", "website": "other"}, {"url": "/own"}, {"url": "", "website": " nj ", "website_url": "/x"}, {"url": "DROP", "canonical_url": 7})
    assert [m.url for m in got] == ["https://www.nj.com/w", "/c", "/own", "https://www.nj.com/x", "7"]


def test_dates(spark):
    a, b, c = metas(spark, {"additional_properties": {"publish_date": "2025-01-01T00:00:00.000Z", "datetime": "  "}}, {"created_date": "d", "additional_properties": None}, {"additional_properties": {"first_publish_date": "f"}})
    assert (a.publish_date, a.datetime, a.first_publish_date) == ("2025-01-01T00:00:00Z", None, "2025-01-01T00:00:00Z")
    assert (b.publish_date, b.datetime, b.first_publish_date) == ("d", "d", "d")
    assert (c.publish_date, c.first_publish_date) == (None, "f")


def test_lists(spark):
    section = {"nj": {"website_section": {"name": " News ", "additional_properties": {"original": {"site": {"site_section": "Local"}}}}}}
    iab = {"product_categories": {"iab_taxonomy": [["Category name: A ", "x"], ["other"], "str", [], ["Category name: A"], ["Category name: "]]}}
    a, b = metas(
        spark,
        {"websites": section, "sections": ["Local", "X", "X", None, " "], "taxonomy": {"tags": [{"slug": "s"}, {"slug": "s"}, {"slug": ""}]}, "tags": "one", "additional_properties": iab, "categories": ["A", "B", "B"]},
        {"tags": ["s", 1, True, " p "], "sections": 5, "categories": {}},
    )
    assert (a.sections, a.tags, a.categories) == (["News", "Local", "X"], ["s", "s", "one"], ["A", "A", "B"])
    assert (b.tags, b.sections, b.categories) == (["s", "1", "True", "p"], ["5"], [])


def test_thumbnails(spark):
    img = lambda u: {"type": "image", "additional_properties": {"thumbnailResizeUrl": u}}
    text = [{"type": "text", "content": "t"}]
    got = metas(spark, {"content_elements": text + [img(" "), img("/a"), img("/b")]}, {"content_elements": text, "thumb": " f "}, {"content_elements": text + [img("/a")], "website": "DROP"}, {"thumb": None})
    assert [m.thumb for m in got] == ["https://www.nj.com/a", "f", "/a", None]


def test_paragraphs_and_other_elements(spark):
    r = one(spark, content_elements=[{"type": "text", "content": "a"}, {"type": "text"}, {"type": "TEXT", "content": "no"}, {"type": "text", "content": None}, {"type": "text", "content": "***"}, {"type": "text", "content": "[b](http://c)"}])
    assert r.text == "a\n\nb"


HAZARDS = [{"taxonomy": None}, {"websites": {"nj": None}}, {"headlines": "x"}, {"additional_properties": [1]}, {"taxonomy": {"tags": ["s"]}}, {"content_elements": [{"type": "text", "content": "t"}, "str"]}, {"content_elements": [{"type": "text", "content": "t"}, {"type": "text", "content": 5}]}]


def test_hazards_permissive(spark):
    got = rows(spark, [article(**h) for h in HAZARDS] + [article(taxonomy={"tags": None}, websites=None)]).orderBy("pos").collect()
    assert all(len(r.shape_warnings) >= 1 and r.reject_reason is None for r in got[:-1]) and got[-1].shape_warnings == []


@pytest.mark.parametrize("hazard", HAZARDS[:2])
def test_hazards_strict(spark, hazard):
    with pytest.raises(Exception, match="unexpected shape"):
        rows(spark, [article(**hazard)], "strict").collect()


def test_keep_first_after_filter(spark):
    docs = [article(_id="x", content_elements=[]), article(_id="x", title="second"), article(_id="x", title="third"), article(_id="y")]
    done = rows(spark, docs)
    kept = D.keep_first(D.accepted(done)).orderBy("pos").collect()
    assert [(r.pos, r.metadata.title) for r in kept] == [(1, "second"), (3, "T")]
    assert tuple(D.counters(done).first()) == (4, 2, 1, 1)


def test_json_output_omits_absent_strings(spark):
    j = json.loads(rows(spark, [article(title=" ", website="", thumb=None)]).select(F.to_json("metadata")).first()[0])
    assert j == {"external_id": "a", "url": "u", "sections": [], "categories": [], "tags": []}
