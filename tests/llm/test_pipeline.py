"""The corpus pipeline on the smallest tables: each stage on its own input, and what its decisions do."""

import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_native import shingles

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@needs_tables
def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    assert ids["toxicity"] >= ids["jaccard_join"] >= ids["decontamination"] == ids["secret_scan"] == ids["best_fit_packing"]
    assert len(ids["toxicity"]) > 150
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in seen["jaccard_join"] if any(100 * len(shingles(r.text) & x) >= 75 * len(x) for x in items)}
    assert ids["decontamination"] == ids["jaccard_join"] - dirty
    assert all(r.n_chars == len(r.text) and 'token = "' not in r.text.replace('token = "[SECRET]"', "") for r in seen["secret_scan"])


@needs_tables
def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_odd_rows_through_all_stages(spark, tmp_path):
    words = lambda p, n=40: " ".join(f"{p}{i}" for i in range(n))
    bad, leak = "utterly vile slur ", words("leak", 12)
    rows = [(i, f"{bad if i % 4 == 0 else ''}{words(chr(97 + i % 26) + str(i))}") for i in range(80)]
    rows += [(None, None), (None, ""), (None, words("solo")), (None, words("solo")), (7, words("other")), (7, rows[7][1]), (90, rows[9][1] + " end"), (91, "x " * 60_000 + leak), (92, "y " * 60_000), (93, f'{words("z")} token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("clash") for c in ("kept", "row", "doc", "node", "leaked_id", "kept_doc_id", "score", "label", "w")})
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)] + [(None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "best_fit_packing":
            assert now.columns == docs.columns
            now.write.parquet(f"{tmp_path}/out-{name}")
            now = spark.read.parquet(f"{tmp_path}/out-{name}")
        out[name] = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in now.collect()) if "text" in now.columns else now.collect()
    clean = [(d, t) for d, t in rows if not (t or "").startswith(bad)]
    assert out["toxicity"] == sorted((-1 if d is None else d, t or "") for d, t in clean)
    # of the copies one stays: without an id, with a repeated one, and near ones
    left = out["jaccard_join"]
    assert len(left) == len(clean) - 3 and sum(t == words("solo") for _, t in left) == 1 and sum(t == "" for _, t in left) == 2
    assert sum(d == 7 for d, _ in left) == 2 and sum(d in (9, 90) for d, _ in left) == 1
    assert out["decontamination"] == [x for x in left if x[0] != 91]
    assert [t for d, t in out["secret_scan"] if d == 93] == [words("z") + ' token = "[SECRET]"'] and len(out["secret_scan"]) == len(left) - 1
    packed = out["best_fit_packing"]
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in packed if r.piece == 0) == [d for d, _ in out["secret_scan"]]
    assert sorted((r.doc_id or -1, r.piece, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id or -1, r.piece, r.length) for r in packed)


def test_empty_table(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_run(rows, toxic, items, secret):
    """What the pipeline leaves of rows (doc_id, text), as (doc_id, piece, start, length, crc32): every stage by its plainest form."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(d, t) for d, t in rows if not toxic(t)]
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    rows = [(d, t) for d, t in rows if find(d) == d]
    rows = [(d, t) for d, t in rows if not any(100 * len(sets[d] & shingles(i)) >= 75 * len(shingles(i)) for i in items)]
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t.replace(secret, "[SECRET]"), add_special_tokens=False).ids, 0], "<u4")
        out |= {(d, k, 2048 * k, len(ids[2048 * k : 2048 * k + 2048]), zlib.crc32(ids[2048 * k : 2048 * k + 2048].tobytes())) for k in range(-(-len(ids) // 2048))}
    return out


def test_run_equals_plain_stages(spark, tmp_path):
    import random

    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "un", "sa"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    bad, secret = "utterly vile slur", "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(i, text(rng.randint(20, 120))) for i in range(120)]
    rows += [(200 + i, f"{bad} {text(30)} {bad}") for i in range(60)]
    rows += [(300 + i, rows[i][1]) for i in range(10)]
    for i in range(15):  # near copies, and near copies of those
        near = rows[20 + i % 5][1].split()
        near[i % len(near)] = word() + "x"
        rows.append((400 + i, " ".join(near)))
    items = [text(25) for _ in range(4)]
    rows += [(500 + i, f"{text(300)} {items[i % 4]} {text(5000 if i == 0 else 50)}") for i in range(8)]
    rows += [(600 + i, f'{text(40)} token = "{secret}" {text(10)}') for i in range(3)]
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(bad in t)) for d, t in rows if d < 260], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_run(rows, lambda t: bad in t, items, secret)
    assert len(got) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    at: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048 and len(at) <= -(-sum(r.length for r in got) // 2048) + 1
