import random
import zlib

import pytest
from pyspark.sql import functions as F


def lower_ascii(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words(t):
    """Runs of other characters than U+0020 and U+0009-U+000D."""
    return (t or "").encode().split()


def crc_fold(key, n):
    return zlib.crc32(str(key).encode()) % n


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): plain, copied, nearly copied, sharing a passage, repeating itself, and the odd cases."""
    rng = random.Random(4)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, rows = text(60), []
    for i in range(60):
        rows.append(text(rng.randint(1, 300)))
    for i in range(15):
        rows.append(rows[i])
    for i in range(15, 35):
        w = rows[i].split()
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    for _ in range(12):
        rows.append(text(80) + "\n" + passage.title() + "\t" + text(30))
    rows += [(text(25) + "\n") * 4, "a " * 70, "x\x85y\xa0z " * 30, "", "  \n", None, "one", "One", "Two words", "q" * 50_000, text(4), (text(50) + " ") * 40]
    return list(enumerate(rows))


#: Names that operators use inside.
CLASHES = ("block", "bucket", "body", "id", "n", "key", "keys", "hashes", "group", "label", "component", "step", "salt", "score", "h", "item", "item_id", "doc", "c", "w", "word", "length")


@pytest.fixture(scope="session")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASHES})
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, block string")
