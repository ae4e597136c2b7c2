"""Sources, sinks, whole runs and the command lines."""

import json

import pytest
from gristmill import cli
from gristmill.operators.embed import FakeEmbedder
from gristmill.operators.validate import report, summary, validate
from gristmill.plans.ingest import run_pipeline
from gristmill.sources import sinks
from gristmill.sources.documents import head, read_documents, read_lines
from gristmill.sources.points import read_points

SMALL = [
    {"_id": "1", "title": "One", "url": "/1", "website": "nj", "sections": ["a"], "categories": ["b"], "tags": ["c"], "thumb": "t", "content_elements": [{"type": "text", "content": "First"}], "additional_properties": {"publish_date": "2025-07-02T00:00:00.000Z"}},
    {"_id": "2", "title": "Two", "url": "/2", "website": "nj", "content_elements": [{"type": "text", "content": "Second"}]},
    {"_id": "3", "title": "Three", "url": "/3", "website": "nj", "content_elements": [{"type": "text", "content": "  "}]},
]


def put(path, what):
    path.write_text(what if isinstance(what, str) else json.dumps(what), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(("what", "n"), [(SMALL, 3), ({"documents": SMALL}, 3), ({"documents": [], "results": SMALL[:2]}, 2), ({"documents": None}, 0), ([], 0), ({"results": {"a": 1}}, 0)])
def test_wrappers(spark, tmp_path, what, n):
    assert read_documents(spark, put(tmp_path / "x.json", what)).count() == n


def test_bad_inputs(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_documents(spark, str(tmp_path / "none.json"))
    with pytest.raises(Exception, match="MALFORMED"):
        read_documents(spark, put(tmp_path / "bad.json", "[{")).collect()
    with pytest.raises(Exception, match="top level"):
        read_documents(spark, put(tmp_path / "scalar.json", "7")).collect()


def test_lines_and_head(spark, tmp_path):
    lines = read_lines(spark, put(tmp_path / "x.jsonl", "\n".join(map(json.dumps, SMALL)) + "\n\n"))
    assert lines.count() == 3
    raw = read_documents(spark, put(tmp_path / "y.json", SMALL))
    assert [head(raw, n).count() for n in (None, 0, 2, 9)] == [3, 0, 2, 3]
    with pytest.raises(ValueError, match="negative"):
        head(raw, -1)


def test_run_writes_documents_points_and_metadata(spark, tmp_path):
    total, n, paths = run_pipeline(spark, put(tmp_path / "in.json", SMALL + [SMALL[0]]), str(tmp_path / "out"), embedder=FakeEmbedder())
    assert (total, n) == (4, 2)
    docs, points = (json.load(open(paths[k])) for k in ("transformed", "points"))
    assert [d["metadata"]["external_id"] for d in docs] == ["1", "2"] and docs[0]["metadata"]["publish_date"] == "2025-07-02T00:00:00Z"
    assert "thumb" not in docs[1]["metadata"] and docs[1]["metadata"]["tags"] == []
    assert points[0]["id"] == "1" and points[0]["vector"] == [0.0] * 8 and points[0]["payload"]["text"] == "First" and points[0]["payload"]["title"] == "One"
    meta = json.load(open(next((tmp_path / "out").glob("run_metadata_*.json"))))
    assert (meta["total_raw"], meta["processed"], meta["skipped"], meta["duplicates_removed"], meta["embeddings_generated"]) == (4, 2, 1, 1, True)
    assert cli.main(["validate", "--path", paths["points"], "--expected-dim", "8"]) == 0
    assert cli.main(["validate", "--path", paths["points"], "--expected-dim", "9"]) == 1


def test_dry_run_empty_input_and_failure(spark, tmp_path):
    path = put(tmp_path / "in.json", SMALL)
    assert run_pipeline(spark, path, str(tmp_path / "dry"), dry_run=True) == (3, 2, {}) and not list((tmp_path / "dry").iterdir())
    _, n, paths = run_pipeline(spark, put(tmp_path / "empty.json", []), str(tmp_path / "e"), keep_history=False, embedder=FakeEmbedder())
    assert n == 0 and json.load(open(paths["transformed"])) == [] and not list((tmp_path / "e").glob("run_metadata*"))

    def broken(texts):
        raise RuntimeError("no provider")

    with pytest.raises(Exception, match="no provider"):
        run_pipeline(spark, path, str(tmp_path / "f"), embedder=broken, keep_history=False)
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == ["transformed.json"]


def test_native_sink(spark, tmp_path):
    _, n, paths = run_pipeline(spark, put(tmp_path / "in.json", SMALL), str(tmp_path / "out"), native=True, skip_embeddings=True)
    assert n == 2 and spark.read.json(paths["transformed"]).count() == 2


def test_cli_ingest(spark, tmp_path):
    path = put(tmp_path / "in.json", SMALL)
    assert cli.main(["ingest", "--input", path, "--output-dir", str(tmp_path / "o"), "--skip-embeddings", "--no-history", "--limit", "1"]) == 0
    assert len(json.load(open(tmp_path / "o" / "transformed.json"))) == 1
    assert cli.main(["ingest", "--input", str(tmp_path / "none"), "--output-dir", str(tmp_path / "o")]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["ingest"])
    assert e.value.code == 2


def test_retention(spark, tmp_path):
    import os

    for i in range(5):
        p = tmp_path / f"transformed_2025010{i}_000000.json"
        p.write_text("[]")
        os.utime(p, (i, i))
    (tmp_path / "transformed_20250109_000000").mkdir()
    (tmp_path / "transformed.json").write_text("[]")
    gone = sinks.clean_up(spark, tmp_path, 3)
    assert sorted(gone) == [f"transformed_2025010{i}_000000.json" for i in range(3)]


GOOD = {"id": "a", "vector": [0.5, 1], "payload": {"text": "t", "title": "T", "url": "u", "external_id": "a"}}
CASES = [
    (GOOD, [], []),
    (GOOD | {"id": None}, ["missing 'id'"], []),
    (GOOD | {"id": 1.5}, ["'id' should be str or int, got float"], []),
    (GOOD | {"id": True}, [], []),
    ({k: v for k, v in GOOD.items() if k != "vector"}, ["missing 'vector'"], []),
    (GOOD | {"vector": "x"}, ["'vector' should be a list, got str"], []),
    (GOOD | {"vector": [1.0]}, ["vector length 1 != expected_dim 2"], []),
    (GOOD | {"vector": [True, float("inf")]}, ["vector[1] is not a finite number (got inf)"], []),
    (GOOD | {"vector": ["1", float("nan")]}, ["vector[0] is not a finite number (got '1')"], []),
    (GOOD | {"payload": None, "id": None}, ["missing 'id'", "missing 'payload'"], []),
    (GOOD | {"payload": [1]}, ["'payload' should be an object, got list"], []),
    (GOOD | {"payload": {"title": 1, "url": 5, "external_id": None}}, ["payload missing required 'text' field"], ["metadata.url is not a string (got int)"]),
    (GOOD | {"payload": {"text": 5, "metadata": "m"}}, ["payload.text should be a string, got int", "payload.metadata exists but is not a dict (got str)", "could not determine metadata dict"], []),
    (GOOD | {"payload": {"text": "  ", "metadata": {"url": None}}}, [], ["payload.text is empty/whitespace", "metadata missing expected field 'title'", "metadata missing expected field 'external_id'"]),
    (GOOD | {"payload": {"text": "t", "metadata": None}}, ["payload.metadata exists but is not a dict (got NoneType)", "could not determine metadata dict"], []),
]


def test_validator(spark, tmp_path):
    found = validate(read_points(spark, put(tmp_path / "p.json", [c[0] for c in CASES])), 2)
    got = found.orderBy("idx").collect()
    for i, (r, (_, errors, warnings)) in enumerate(zip(got, CASES, strict=True)):
        assert r.errors == [f"[idx={i}] {e}" for e in errors], CASES[i]
        assert r.warnings == [f"[idx={i}] {w}" for w in warnings], CASES[i]
    n = sum(len(c[1]) for c in CASES), sum(len(c[2]) for c in CASES)
    assert tuple(summary(found).first()) == (len(CASES), *n) and report(found, "errors").count() == n[0]


def test_point_files(spark, tmp_path):
    two = json.dumps(GOOD) + "\n\n" + json.dumps(GOOD) + "\n"
    assert read_points(spark, put(tmp_path / "a.jsonl", two)).count() == 2
    assert read_points(spark, put(tmp_path / "b.json", [])).count() == 0
    for name, text in (("one", json.dumps(GOOD)), ("bad", json.dumps(GOOD) + "\n{nope\n"), ("list", json.dumps(GOOD) + "\n[1]\n"), ("empty", "")):
        with pytest.raises(ValueError):
            read_points(spark, put(tmp_path / f"{name}.json", text)).count()


def test_positions_go_on_over_files(spark, tmp_path):
    for name, ids in (("b.json", [3, 4]), ("a.json", [1, 2]), ("c.json", [])):
        (tmp_path / name).write_text(json.dumps([{"_id": i} for i in ids]))
    rows = read_documents(spark, str(tmp_path))
    got = sorted((r.pos, r.id) for r in rows.selectExpr("pos", "variant_get(doc, '$._id', 'int') AS id").collect())
    assert got == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert head(rows, 3).count() == 3


def test_lines_and_native_run(spark, tmp_path):
    docs = [{"_id": str(i % 5), "title": "t", "url": "https://a.example/x", "content_elements": [{"type": "text", "content": f"text {i}"}]} for i in range(8)]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, docs)))
    total, kept, paths = run_pipeline(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), limit=7, native=True, lines=True, skip_embeddings=True)
    assert (total, kept) == (8, 5) and spark.read.json(paths["transformed"]).count() == 5
    facts = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("run_metadata")]
    assert json.loads(facts[0].read_text())["processed"] == 5


def test_rejects_and_broken_lines(spark, tmp_path):
    docs = [json.dumps(d) for d in SMALL]
    path = put(tmp_path / "in.jsonl", "\n".join([docs[0], "{nope", docs[1], docs[2]]))
    with pytest.raises(ValueError, match="1 of 4 lines"):
        run_pipeline(spark, path, str(tmp_path / "a"), lines=True, skip_embeddings=True)
    assert list((tmp_path / "a").iterdir()) == []
    total, kept, paths = run_pipeline(spark, path, str(tmp_path / "b"), lines=True, skip_embeddings=True, rejects=True, most_broken=0.5)
    found = json.load(open(paths["rejected"]))
    assert (total, kept) == (4, 2) and [r["reject_reason"] for r in found] == ["malformed", "text"]
    assert found[0]["broken"]["text"] == "{nope" and found[0]["broken"]["file"].endswith("in.jsonl") and found[0]["place"] < found[1]["place"]
    with pytest.raises(Exception, match="MALFORMED"):
        run_pipeline(spark, path, str(tmp_path / "c"), lines=True, skip_embeddings=True, mode="strict")


def test_embedding_without_a_key_fails(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    monkeypatch.delenv("USE_FAKE_EMBEDDINGS", raising=False)
    with pytest.raises(ValueError, match="OPENAI_API_KEY"):
        run_pipeline(spark, put(tmp_path / "in.json", SMALL), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    monkeypatch.setenv("USE_FAKE_EMBEDDINGS", "1")
    assert run_pipeline(spark, str(tmp_path / "in.json"), str(tmp_path / "out"))[1] == 2


def test_input_is_scanned_once(spark, tmp_path):
    """What the transformation writes is all that later steps read."""
    path = put(tmp_path / "in.json", SMALL)
    read = []
    import gristmill.plans.ingest as I

    original = I.D.transform
    try:
        I.D.transform = lambda raw, *a, **b: read.append(raw) or original(raw, *a, **b)
        run_pipeline(spark, path, str(tmp_path / "out"), skip_embeddings=True, rejects=True)
    finally:
        I.D.transform = original
    assert len(read) == 1 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]


def test_run_with_stored_vectors(spark, tmp_path):
    path, log = put(tmp_path / "in.json", SMALL), tmp_path / "log"
    log.mkdir()
    folder = str(log)

    def embed(texts):
        import uuid

        with open(f"{folder}/{uuid.uuid4()}", "w") as f:
            f.write("x" * len(texts))
        return [[float(len(t))] for t in texts]

    for name in ("a", "b"):
        _, n, paths = run_pipeline(spark, path, str(tmp_path / name), embedder=embed, vector_store=str(tmp_path / "v"))
        assert n == 2 and [p["vector"] for p in json.load(open(paths["points"]))] == [[5.0], [6.0]]
    assert sum(len(p.read_text()) for p in log.iterdir()) == 2
