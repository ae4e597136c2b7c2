"""Odd inputs on which queries were found to differ from their SQL."""

from pathlib import Path

import duckdb

from gristmill.plans.runs import ORACLES, QUERIES


def test_quarantined_lines_of_equal_text(spark, tmp_path):
    spark.createDataFrame([(1, "kept"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "u"), (2, "v"), (3, "u"), (4, None), (5, "u")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, QUERIES["quarantined_lines"](spark, str(tmp_path)).collect()))
    assert got == [(1, "kept", "kept"), (1, "malformed", "{u"), (2, "malformed", "{v"), (3, "malformed", "{u"), (5, "malformed", "{u")]


#: Page texts with cut references, those that no SQL decodes, nested ones, and none.
ODD_PAGES = [None, "", "&", "a &quot", "a = &quot</title>", "&quot;&quot", "&copy 2 &copy; &copyx", "&middot3 &middot;", "&lt;b&gt; &nbsp; &#39;&#x27; &reg", "&amp &ampx &amp;x &amp;amp; &amp;copy; &amp;quot", "&&amp;&am&a;&amp#39;", "&ampaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa;&copy;", "&Copy; &AMP; &QUOT", "\U0001f600&quot;\U0001f600&amp"]


def against_sql(spark, name, folder):
    """Rows of a query and of its SQL over the tables in a folder, sorted."""
    c = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}/*.parquet'")
    result = c.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).select(*columns).collect()), key=repr), sorted(result.fetchall(), key=repr)


def test_html_unescape_decodes_what_its_sql_does(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD_PAGES)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got, want = against_sql(spark, "html_unescape", tmp_path)
    assert got == want and len(got) == len(ODD_PAGES)


def test_clean_fragment_cleans_what_its_sql_does(spark, tmp_path):
    marked = ["\xa0<b>a  b</b> &quot", "[a &quot;b&quot;](/u)  &lt;i&gt; 　", "<p>&quot</p>", "<>&amp;<\n>"]
    spark.createDataFrame(list(enumerate(ODD_PAGES + marked)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got, want = against_sql(spark, "clean_fragment", tmp_path)
    assert got == want and len(got) == len(ODD_PAGES + marked)


def odd_documents(spark, folder):
    """Documents of which some have no text, in every way in which a text may be none; keys that meet modulo 400."""
    texts = [None, "", " \n ", "***\n---", "<br>", "&nbsp;", "Some  text.", "end"]
    keys = list(range(1, 60)) + list(range(401, 460)) + [4400, 4413]
    spark.createDataFrame([(k, texts[i % len(texts)]) for i, k in enumerate(keys)], "doc_id long, text string").write.parquet(str(folder / "documents.parquet"))


def test_reject_reasons_of_documents_without_text(spark, tmp_path):
    odd_documents(spark, tmp_path)
    for name in ("reject_reasons", "dedupe_after_filter"):
        got, want = against_sql(spark, name, tmp_path)
        assert got == want and got


def test_run_counters_of_documents_without_text(spark, tmp_path):
    odd_documents(spark, tmp_path)
    got, want = against_sql(spark, "run_counters", tmp_path)
    assert got == want and got[0][3] > 0


def test_run_metadata_of_documents_without_text(spark, tmp_path):
    odd_documents(spark, tmp_path)
    for name in ("run_metadata", "dry_run", "stream_keep_first"):
        got, want = against_sql(spark, name, tmp_path)
        assert got == want and got
