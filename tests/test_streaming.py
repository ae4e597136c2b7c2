"""The stream keeps the first of each id, however its input is split, and replays add nothing."""

import json

import pyarrow as pa
import pytest
from gristmill.plans.ingest import prepare
from gristmill.sources.documents import read_lines
from gristmill.streaming.ingest import batch_sink, documents, documents_of, read_stream, start


def article(i, text):
    return {"_id": i, "url": "u", "content_elements": [{"type": "text", "content": f"<b>{text}</b>"}]}


def put(folder, name, own):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(a) for a in own) + "\n\n")


FILES = {"a.jsonl": [article("1", "a0"), article("2", "a1"), article("1", "a2"), article(None, "no id")], "b.jsonl": [article("2", "b0"), article("3", "b1"), article("3", "  ")], "c.jsonl": [article("4", "c0"), article("1", "c1"), article("3", "c2"), article("4", "c3")]}
FIRST = {"1": "a0", "2": "a1", "3": "b1", "4": "c0"}


def drain(spark, tmp_path, sink=None, files_at_once=None):
    query = start(documents(read_stream(spark, str(tmp_path / "in"), files_at_once)), sink or batch_sink(str(tmp_path / "out")), str(tmp_path / "cp"))
    query.awaitTermination(300)
    assert query.exception() is None


def texts(spark, tmp_path):
    return {r.id: r.text for r in documents_of(spark, str(tmp_path / "out")).collect()}


def test_any_split_gives_the_same(spark, tmp_path):
    for name in ("c.jsonl", "a.jsonl", "b.jsonl"):  # a run, and so a micro-batch, for each file, out of order
        put(tmp_path / "in", name, FILES[name])
        drain(spark, tmp_path)
    assert texts(spark, tmp_path) == FIRST
    rows = prepare(read_lines(spark, str(tmp_path / "in"))).select("metadata.external_id", "text").collect()
    assert {r.external_id: r.text for r in rows} == FIRST


def test_one_batch_and_a_replay(spark, tmp_path):
    for name, own in FILES.items():
        put(tmp_path / "in", name, own)
    sink, failed = batch_sink(str(tmp_path / "out")), []

    def fails_once(rows, number):
        sink(rows, number)
        if not failed:
            failed.append(number)
            raise RuntimeError("after the write")

    with pytest.raises(Exception, match="after the write"):
        drain(spark, tmp_path, fails_once)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    drain(spark, tmp_path, fails_once)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4 and texts(spark, tmp_path) == FIRST
    drain(spark, tmp_path)  # nothing new
    assert texts(spark, tmp_path) == FIRST


def test_batches_of_python_workers_are_bounded_in_bytes(spark, tmp_path):
    put(tmp_path / "in", "a.jsonl", [article(str(i), "x" * 400_000) for i in range(60)])
    got = []

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": [b.num_rows], "size": [b.nbytes]})

    drain(spark, tmp_path, lambda rows, number: got.extend(map(tuple, rows.select("id", "text").repartition(1).mapInArrow(sizes, "n long, size long").collect())))
    assert sum(n for n, _ in got) == 60 and max(size for _, size in got) < 6 << 20
