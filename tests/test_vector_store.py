"""Each distinct text is asked for once, whatever fails and is run again."""

import json

import pytest
from gristmill.operators.vector_store import VectorStore, paced


def counting(folder, refused=()):
    """An embedder that writes down every text it answers; it refuses batches with a text in `refused` while a file exists."""
    folder, refused = str(folder), set(refused)

    def embed(texts):
        import json
        import os
        import uuid

        if os.path.exists(f"{folder}/down") and refused & set(texts):
            raise ConnectionError("provider is down")
        with open(f"{folder}/{uuid.uuid4()}.calls", "w") as f:
            json.dump(texts, f)
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def asked(folder):
    return sorted(t for p in folder.glob("*.calls") for t in json.loads(p.read_text()))


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)


def lengths(df):
    return {r.id: None if r.vector is None else r.vector[0] for r in df.collect()}


def test_asks_for_new_texts_only(spark, tmp_path):
    store, log = VectorStore(spark, str(tmp_path / "v"), 4), tmp_path / "log"
    log.mkdir()
    texts = ["a", "bb", "a", None, "", "long " * 30, "a"]
    assert lengths(store.attach(docs(spark, texts), counting(log), batch=2, max_chars=20)) == {0: 1, 1: 2, 2: 1, 3: None, 4: 0, 5: 19, 6: 1}
    assert asked(log) == sorted(["a", "bb", "", "long long long long"])
    again = VectorStore(spark, str(tmp_path / "v")).attach(docs(spark, [*texts, "new"]), counting(log), batch=2, max_chars=20)
    assert lengths(again)[7] == 3 and len(asked(log)) == 5
    store.attach(docs(spark, ["a"]), counting(log), model="another", max_chars=20)
    assert asked(log).count("a") == 2


def test_failed_batches_are_asked_again_and_others_are_not(spark, tmp_path):
    store, log = VectorStore(spark, str(tmp_path / "v"), 4), tmp_path / "log"
    log.mkdir()
    (log / "down").touch()
    texts = [f"text {i}" for i in range(20)]
    with pytest.raises(RuntimeError, match="provider is down"):
        store.attach(docs(spark, texts), counting(log, {"text 7"}), batch=3)
    before = asked(log)
    assert 0 < len(before) < 20 and len(set(before)) == len(before) and "text 7" not in before
    (log / "down").unlink()
    assert lengths(store.attach(docs(spark, texts), counting(log, {"text 7"}), batch=3)) == {i: len(t) for i, t in enumerate(texts)}
    assert asked(log) == sorted(texts)  # none twice


def test_pace_is_shared():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    call = paced(lambda texts: [], 60, 4, lambda: now[0], sleep)  # four tasks, sixty calls a minute: one in four seconds each
    for _ in range(4):
        call([])
        now[0] += 1
    assert now[0] == 13 and waits == [3, 3, 3]
    assert paced(len, None, 4) is len
