"""Snapshots of a keyed table: merges against a dictionary, racing writers, retention."""

import random
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from gristmill.sources import files
from gristmill.sources.store import Conflict, Store
from pyspark.sql.types import StructType

SCHEMA = StructType().add("id", "string").add("seen", "long").add("text", "string")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(df):
    return {r.id: (r.seen, r.text) for r in df.collect()}


def test_merges_equal_a_dictionary(spark, tmp_path):
    rng, store, want, history = random.Random(1), Store(spark, str(tmp_path / "t")).create(SCHEMA, "id", "seen", 8), {}, [{}]
    for batch in range(4):
        rows = [(f"k{rng.randrange(40)}", 10 * batch + rng.randrange(25), f"{batch}-{i}") for i in range(25)]
        rows = list({(k, v): (k, v, t) for k, v, t in rows}.values())
        for k, v, t in sorted(rows, key=lambda r: r[1]):
            if k not in want or v >= want[k][0]:
                want[k] = (v, t)
        gone = [f"k{rng.randrange(40)}"]
        want.pop(gone[0], None)
        assert store.merge(frame(spark, rows), spark.createDataFrame([(gone[0],)], "id string")) == batch + 1
        history.append(dict(want))
    assert [state(store.read(n)) for n in store.versions()] == history and state(store.read()) == want
    some = sorted(want)[:3]
    assert state(store.lookup(some)) == {k: want[k] for k in some}


def test_only_touched_buckets_are_rewritten_and_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t")).create(SCHEMA, "id", "seen", 16)
    store.merge(frame(spark, [(f"k{i}", 0, "a") for i in range(200)]))
    before = store.manifest().folders
    store.merge(frame(spark, [("k3", 1, "b"), ("new", 0, "c")]))
    after = store.manifest().folders
    changed = [b for b in after if before.get(b) != after[b]]
    assert len(before) == 16 and 1 <= len(changed) <= 2
    assert len(store._rows(store.manifest(), changed).inputFiles()) < len(store.read().inputFiles()) / 4
    assert store.read().count() == 201 and state(store.read())["k3"] == (1, "b")


def test_stored_rows_survive_older_changes_and_lose_to_equal_ones(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t")).create(SCHEMA, "id", "seen", 2)
    store.merge(frame(spark, [("a", 5, "old"), ("b", 5, "old")]))
    store.merge(frame(spark, [("a", 4, "late"), ("b", 5, "again")]))
    assert state(store.read()) == {"a": (5, "old"), "b": (5, "again")}


def test_racing_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t")).create(SCHEMA, "id", "seen", 4)
    base = store.manifest()
    assert store._merged(base, frame(spark, [("a", 1, "x")]), None) == 1
    assert store._merged(base, frame(spark, [("b", 1, "y")]), None) is None  # from the same snapshot
    assert state(store.read()) == {"a": (1, "x")} and len(list(Path(tmp_path / "t" / "data").iterdir())) == 1
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda i: store.merge(frame(spark, [(f"c{i}", i, "z")]), retries=9), range(4)))
    assert sorted(done) == [2, 3, 4, 5] and set(state(store.read())) == {"a", "c0", "c1", "c2", "c3"}


def test_conflict_without_retries(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "t")).create(SCHEMA, "id", "seen", 4)
    monkeypatch.setattr(files, "create_once", lambda *a: False)
    with pytest.raises(Conflict):
        store.merge(frame(spark, [("a", 1, "x")]), retries=1)


def test_failed_write_leaves_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t")).create(SCHEMA, "id", "seen", 4)
    store.merge(frame(spark, [("a", 1, "x")]))
    bad = frame(spark, [("a", 2, "x")]).selectExpr("id", "seen", "CAST(raise_error('broken') AS STRING) AS text")
    with pytest.raises(Exception, match="broken"):
        store.merge(bad)
    assert store.versions() == [0, 1] and len(list(Path(tmp_path / "t" / "data").iterdir())) == 1


def test_retention(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t")).create(SCHEMA, "id", "seen", 4)
    for i in range(4):
        store.merge(frame(spark, [("a", i, f"v{i}"), (f"b{i}", i, "x")]))
    want = [state(store.read(n)) for n in (3, 4)]
    assert store.retain(2) == 0  # all are young
    assert store.versions() == [3, 4]
    assert store.retain(2, grace=-5) > 0
    assert [state(store.read(n)) for n in (3, 4)] == want
    named = {p for n in (3, 4) for p in store.manifest(n).folders.values()}
    there = {f"{b.parent.name}/{b.name}" for b in (tmp_path / "t" / "data").glob("*/*") if b.is_dir()}
    assert there == named


def test_refusals(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        store.read()
    store.create(SCHEMA, "id", "seen")
    with pytest.raises(FileExistsError):
        store.create(SCHEMA, "id", "seen")
    with pytest.raises(ValueError, match="without id"):
        store.merge(frame(spark, [(None, 1, "x")]))
    assert store.read().count() == 0 and store.read().columns == SCHEMA.names


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t")).create(SCHEMA, "id", "seen", 1)
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        store.merge(spark.range(0, 6000, 1, 8).selectExpr("CAST(id AS STRING) AS id", "id AS seen", "sha2(CAST(id AS STRING), 512) AS text"))
    finally:
        for key in small:
            spark.conf.unset(key)
    assert len(store.read().inputFiles()) > 1 and store.read().count() == 6000
