"""Large arrays read in byte ranges, against the parser of Python; arrays written by all tasks."""

import json
import random

import pytest
from gristmill.sources import arrays, sinks
from gristmill.sources.documents import read_documents
from gristmill.sources.points import read_points
from pyspark.sql import functions as F

PIECES = ["{", "}", "[", "]", ",", '"', "\\", '\\"', "\n", "é", "😀", "a", " ", ":", "}{", '",{"', " "]


def value(rng, depth=0):
    kind = rng.random()
    if kind < 0.35:
        return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
    if kind < 0.5 or depth > 3:
        return rng.choice([None, True, False, 0, -1.5, 12])
    if kind < 0.7:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(["a", "b", "}", '"', "c,"]): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def split_small(spark, n):
    spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)


@pytest.fixture
def small_ranges(spark):
    split_small(spark, 64)
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def read(spark, path):
    rows = arrays.read_array(spark, str(path)).select("pos", F.to_json("doc").alias("doc")).collect()
    return [(r.pos, json.loads(r.doc)) for r in sorted(rows)]


@pytest.mark.parametrize("seed", range(4))
def test_equals_parser_across_cuts(spark, tmp_path, small_ranges, seed):
    rng = random.Random(seed)
    objects = lambda: {"id": value(rng), "s": value(rng)}
    data = [objects() if rng.random() < 0.8 or seed < 3 else value(rng) for _ in range(35)]
    text = json.dumps(data, ensure_ascii=seed % 2 == 0, indent=rng.choice([None, 1, 2]))
    (tmp_path / "x.json").write_text(" \n" * (seed % 3) + text + "\n" * (seed % 2 * 70), encoding="utf-8")
    assert len({r.start for r in arrays._summaries(spark, str(tmp_path / "x.json")).collect()}) > 5
    assert read(spark, tmp_path / "x.json") == list(enumerate(data))


def test_every_length_of_the_end(spark, tmp_path, small_ranges):
    """The last brackets fall on either side of a boundary."""
    for n in range(52, 66, 2):
        data = [{"a": "x" * n}, {"b": 1}]
        (tmp_path / "x.json").write_text(json.dumps(data), encoding="utf-8")
        assert read(spark, tmp_path / "x.json") == list(enumerate(data))


@pytest.mark.parametrize("text", ["[]", " [ ]\n", "[1]", '["}"]', "[[], {}]", "[{}]", "[1, {}, 2, 3, {}, 4]", "[null,\n{}]"])
def test_small_cases(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    assert read(spark, tmp_path / "x.json") == list(enumerate(json.loads(text)))


@pytest.mark.parametrize("text", ['[{"a":1} {"b":2}]', '[{"a":1},]', '[{"a":1}', '[{"a":1}]]', '[{"a":1},,{"b":2}]', '[{"a":"}]', '[{"a":1}}', '[,{"a":1}]', '[{"a":1}];', '[{"a" 1}]', "[", '[{"a":1}] x', '{"documents": [{"a":1} {"b":2}]}', '{"documents": [{"a":1}], }', '{"documents": [{"a":1}]'])
def test_malformed_arrays_fail(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="MALFORMED"):
        read(spark, tmp_path / "x.json")


def test_several_files_and_documents(spark, tmp_path, small_ranges, monkeypatch):
    data = [{"_id": i, "t": "}\\\"" * (i % 5)} for i in range(60)]
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps(data[20 * i : 20 * i + 20]))
    assert read(spark, tmp_path) == list(enumerate(data))
    whole = sorted((r.pos, r.d) for r in read_documents(spark, str(tmp_path)).select("pos", F.to_json("doc").alias("d")).collect())
    monkeypatch.setattr(arrays, "LARGE", 1)
    split = sorted((r.pos, r.d) for r in read_documents(spark, str(tmp_path)).select("pos", F.to_json("doc").alias("d")).collect())
    assert whole == split and len(split) == 60


@pytest.mark.parametrize("seed", range(3))
def test_wrapped_lists_across_cuts(spark, tmp_path, small_ranges, seed):
    rng = random.Random(100 + seed)
    data = [{"id": value(rng), "s": value(rng)} if rng.random() < 0.8 else value(rng) for _ in range(25)]
    other = [value(rng) for _ in range(12)]
    outer = [{"meta": {"a": {"b": 1}, "documents": [{}]}, "documents": data, "results": other, "n": 5}, {"results": other, "documents": None, "x": "}]", "results": data}, {"documents": [], "z": [{}, {}], "results": data}][seed]
    if seed == 1:
        text = '{"results": %s, "documents": null, "x": "}]", "results": %s}' % (json.dumps(other), json.dumps(data))  # noqa: UP031
    else:
        text = json.dumps(outer, ensure_ascii=False, indent=[None, 1, 2][seed])
    (tmp_path / "x.json").write_text(text, encoding="utf-8")
    assert read(spark, tmp_path / "x.json") == list(enumerate(data))


def test_wrappers_without_a_list(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "LARGE", 1)
    for text, n in (('{"documents": [{"a": 1}, {"a": 2}]}', 2), ('{"documents": {"a": 1}, "results": [1]}', 0), ('{"documents": [ ], "results": [7, {}]}', 2), ("{}", 0), ('{"documents": [\n]}', 0), ('{"documents": 5, "results": [1]}', 0)):
        (tmp_path / "x.json").write_text(text)
        assert read_documents(spark, str(tmp_path / "x.json")).count() == n, text
    monkeypatch.setattr(arrays, "OUTSIDE", 10)
    (tmp_path / "x.json").write_text('{"documents": [{"a": 1}], "long": "%s"}' % ("x" * 99))  # noqa: UP031
    assert arrays.read_chunks(spark, str(tmp_path / "x.json")) is None and read_documents(spark, str(tmp_path / "x.json")).count() == 1


def test_points_in_ranges(spark, tmp_path, small_ranges, monkeypatch):
    points = [{"id": str(i), "vector": [i / 2, float("nan") if i == 5 else 1.0], "payload": {"text": "} ,{" * i}} for i in range(40)]
    (tmp_path / "p.json").write_text(json.dumps(points))
    show = lambda: sorted((r.idx, r.i, r.v, r.p) for r in read_points(spark, str(tmp_path / "p.json")).select("idx", F.to_json("id").alias("i"), F.to_json("vector").alias("v"), F.to_json("payload").alias("p")).collect())
    whole = show()
    monkeypatch.setattr(arrays, "LARGE", 1)
    assert show() == whole and len(whole) == 40


def written(tmp_path, name="out.json"):
    return (tmp_path / name).read_text(encoding="utf-8")


@pytest.mark.parametrize("n", [0, 1, 2, 57])
def test_array_sink(spark, tmp_path, n):
    texts = ["x", "é\n\t\"\\ \x0b\x1f\x7f", "", " 😀", "{},\n"]
    data = [{"text": texts[i % 5], "m": {"tags": ["a"] * (i % 3), "none": "s" if i % 2 else None}} for i in range(n)]
    df = spark.createDataFrame([(7 * i, d["text"], (d["m"]["tags"], d["m"]["none"])) for i, d in enumerate(data)], "pos long, text string, m struct<tags:array<string>,none:string>").repartition(6)
    (tmp_path / "out.json").write_text("old")
    assert sinks.export_array(df, tmp_path / "out.json") == n
    want = [{"text": d["text"], "m": {k: v for k, v in d["m"].items() if v is not None}} for d in data]
    assert written(tmp_path) == json.dumps(want, ensure_ascii=False, indent=2)
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["out.json"]


def test_failing_task_leaves_nothing(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("pos"), F.when(F.col("id") == 40, F.raise_error(F.lit("broken row")).cast("string")).otherwise("x").alias("t"))
    (tmp_path / "out.json").write_text("old")
    with pytest.raises(Exception, match="broken row"):
        sinks.export_array(df, tmp_path / "out.json")
    assert written(tmp_path) == "old" and [p.name for p in tmp_path.iterdir()] == ["out.json"]
