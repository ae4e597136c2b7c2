"""Secret scans: a random forest over pattern candidates, to remove false positives.

Candidates are long runs of key-like characters. Each is described by its length, changes
between character classes, share that dictionary words cover, whether it stands in a path or
URL, and the words beside it. A random forest, trained from labelled findings, votes. The
forest is grown on the driver from a bounded list and then becomes a Column of nested CASE
expressions: candidates, features and votes are all column expressions, without a shuffle, and
no Python runs on the executors.

Defined cases: null and blank texts have no candidates. Repeated rows each report theirs.
A text of any length is read whole. Other columns are not read when scanning, and are kept as
they are when redacting. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import let

CANDIDATE = r"[A-Za-z0-9_+/=\-]{16,}"
#: Findings of each label to train on, at most; of more, those of the least hashes.
MAX_FINDINGS = 4000
TREES, DEPTH, LEAST = 15, 6, 8
MASK = "[SECRET]"
#: Words whose presence in a candidate speaks for an identifier.
DICTIONARY = "account action admin api app array auth base build cache call case check class client code color column config content control copy core count create css data date default delete demo description develop document domain edit element email end error event example exception export field file filter folder font form format function get group handler header hello home host html http https image import index info init input instance item java job json key label lang language last layout length level library license link list load local lock log login main manager map media message method mode model module name net network new node number object option order org output package page param parent path plugin port post process product profile project property public query read record release remove report request resource response result return root row save script search section select server service session set setting shop show sign size sort source src start state static status step store stream string style submit success system table tag target task template test text theme time title tmp tool total type update upload url user util value version video view web window word work world write www xml year".split()
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "auth", "authorization", "bearer", "credential", "private")
OTHER_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "id", "etag", "revision", "rev", "build", "see", "path", "file", "url", "image", "class", "package", "import")
FEATURES = ("length", "transitions", "dictionary", "digits", "distinct", "upper", "hex", "dashes", "in_path", "in_url", "secret_word", "other_word", "assigned", "quoted")


def _any_word(context: Column, names: tuple[str, ...]) -> Column:
    return context.rlike(r"(?i)(^|[^A-Za-z0-9])(" + "|".join(names) + r")s?([^A-Za-z0-9]|$)").cast("int")


def features(token: Column, word: Column, before: Column) -> dict[str, Column]:
    """token: the candidate; word: the run without white space around it; before: the two words ahead of it."""
    n = F.length(token)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    changes = F.length(F.regexp_replace(F.regexp_replace(classes, "[^aA0]", "-"), r"(.)\1*", "x")) - 1
    longest_first = sorted(DICTIONARY, key=lambda w: (-len(w), w))
    uncovered = F.length(F.regexp_replace(F.lower(token), "|".join(w for w in longest_first if len(w) > 2), ""))
    lead = F.left(word, F.position(token, word) - 1)
    context = F.concat_ws(" ", before, lead)
    out = {
        "length": n,
        "transitions": changes / n,
        "dictionary": 1 - uncovered / n,
        "digits": F.length(F.regexp_replace(token, "[^0-9]", "")) / n,
        "distinct": F.size(F.array_distinct(F.split(token, ""))) / n,
        "upper": F.length(F.regexp_replace(token, "[^A-Z]", "")) / n,
        "hex": token.rlike("^[0-9a-fA-F]+$").cast("int"),
        "dashes": F.length(F.regexp_replace(token, "[^_/-]", "")) / n,
        "in_path": (F.length(F.regexp_replace(word, r"[^/\\]", "")) + word.rlike(r"\.[a-z]{2,4}$").cast("int")),
        "in_url": word.contains("://").cast("int"),
        "secret_word": _any_word(context, SECRET_WORDS),
        "other_word": _any_word(context, OTHER_WORDS),
        "assigned": F.rtrim(F.regexp_replace(context, r"[\"']+$", "")).rlike("(=|:)$").cast("int"),
        "quoted": lead.rlike("[\"'`]$").cast("int"),
    }
    return {k: v.cast("double") for k, v in out.items()}


def labelled_findings(seed: int = 5, n: int = 3000) -> list[tuple[str, str, str, int]]:
    """(before, word, token, label): findings of known kinds, made by rule; a caller may pass real ones instead."""
    rng = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, lo, hi: "".join(rng.choice(chars) for _ in range(rng.randint(lo, hi)))
    filler = lambda: pick(low, 2, 9)
    out = []
    for _ in range(n):
        if rng.random() < 0.5:
            kind = rng.randrange(4)
            token = (pick("0123456789abcdef", 32, 64), pick(low + up + dig, 20, 64), "AKIA" + pick(up + dig, 16, 16), pick(low, 2, 3) + "_" + pick(low + up + dig, 30, 40))[kind]
            name = rng.choice(SECRET_WORDS) if rng.random() < 0.9 or kind == 0 else filler()
            form = rng.randrange(4)
            before, word = ((f"{name} =", f'"{token}"'), (f"{filler()} {name}:", token), (f"{filler()} {filler()}", f"{name}={token}"), (f"{filler()} {name}", token))[form]
            out.append((before, word, token, 1))
        else:
            kind = rng.randrange(6)
            names = [rng.choice(DICTIONARY) for _ in range(rng.randint(3, 6))]
            ident = rng.choice(("_", "-", "")).join(names).ljust(16, "s")
            token = (ident, "/".join(["", *names, *names])[:60].ljust(16, "x"), pick("0123456789abcdef", 32, 40), rng.choice((str.lower, str.upper, str.title))(pick(low, 16, 40)), "-".join(pick("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)), pick("=_-+", 1, 1) * rng.randint(16, 40))[kind]
            name = rng.choice(OTHER_WORDS) if kind in (2, 4) or rng.random() < 0.3 else (rng.choice(SECRET_WORDS) if kind in (0, 3, 5) and rng.random() < 0.3 else filler())
            form = rng.randrange(4)
            lead = rng.choice(("https://www.", "", "", "./")) if kind == 1 else ""
            before, word = ((f"{name} =", f'"{token}"'), (f"{filler()} {name}:", token), (f"{filler()} {filler()}", lead + token + rng.choice((".html", ".py", ""))), (f"{filler()} {name}", token))[form]
            out.append((before, word, token, 0))
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH):
    """A tree: a share of ones, or (feature, cut, left, right); left is below the cut."""
    if depth == 0 or len(y) < 2 * LEAST or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= LEAST) & (len(y) - at - 1 >= LEAST)]
        if not len(at):
            continue
        left, right = at + 1, len(y) - at - 1
        p, q = ones[at] / left, (ones[-1] - ones[at]) / right
        impurity = left * p * (1 - p) + right * q * (1 - q)
        k = int(impurity.argmin())
        if best is None or impurity[k] < best[0]:
            best = (float(impurity[k]), int(f), float((v[at[k]] + v[at[k] + 1]) / 2))
    if best is None:
        return float(y.mean())
    _, f, cut = best
    low = x[:, f] < cut
    return f, cut, grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1)


def tree_sql(tree) -> str:
    if isinstance(tree, float):
        return f"{tree:.6f}D"
    f, cut, left, right = tree
    return f"CASE WHEN {FEATURES[f]} < {cut!r}D THEN {tree_sql(left)} ELSE {tree_sql(right)} END"


def sample(findings: list[tuple[str, str, str, int]]) -> list[tuple[str, str, str, int]]:
    """At most MAX_FINDINGS of each label, chosen by hash whatever the order of the list; they stay in its order."""
    place = lambda i: (hashlib.blake2b(json.dumps(findings[i]).encode(), digest_size=8).digest(), i)
    by_label: dict[int, list[int]] = {}
    for i, f in enumerate(findings):
        by_label.setdefault(f[3], []).append(i)
    return [findings[i] for i in sorted(i for own in by_label.values() for i in (own if len(own) <= MAX_FINDINGS else sorted(own, key=place)[:MAX_FINDINGS]))]


def train(spark: SparkSession, findings: list[tuple[str, str, str, int]], seed: int = 3) -> list:
    """The trees; features of the findings come from the same expressions as those of candidates."""
    rows = json.dumps([dict(zip(("before", "word", "token", "label"), f, strict=True)) for f in sample(findings)])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<before:string,word:string,token:string,label:int>>")))
    got = table.select("label", *(c.alias(k) for k, c in features(F.col("token"), F.col("word"), F.col("before")).items())).collect()
    data = np.array([list(r) for r in got], float)
    rng = np.random.default_rng(seed)
    trees = []
    for _ in range(TREES):
        rows_ = rng.integers(0, len(data), len(data))
        trees.append(grow(data[rows_, 1:], data[rows_, 0], rng))
    return trees


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _suspects(text: Column) -> Column:
    """position, word and before of every word that holds a candidate; texts without one are not split."""

    def one(own: Column):
        return lambda word, i: F.when(
            (F.length(word) >= 16) & word.rlike(CANDIDATE),
            F.struct(i.cast("long").alias("position"), word.alias("word"), F.array_join(F.slice(own, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), " ").alias("before")),
        )

    return F.when(text.rlike(CANDIDATE), let(_words(text), lambda own: F.filter(F.transform(own, one(own)), lambda x: x.isNotNull())))


def _tokens(word: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(word, F.lit(CANDIDATE), F.lit(0)))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, position (word number from 0), token, word and before of every candidate."""
    text = F.col("text").cast("string")
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(_suspects(text)).alias("c"))
    return each.select("doc_id", "c.position", F.explode(_tokens(F.col("c.word"))).alias("token"), "c.word", "c.before")


def scan(docs: DataFrame, findings: list[tuple[str, str, str, int]] | None = None) -> DataFrame:
    """doc_id, position, token, score (share of the forest) and is_secret of every candidate."""
    trees = train(docs.sparkSession, findings or labelled_findings())
    vote = "(" + " + ".join(tree_sql(t) for t in trees) + f") / {len(trees)}.0D"
    described = candidates(docs).withColumns(features(F.col("token"), F.col("word"), F.col("before")))
    return described.select("doc_id", "position", "token", F.expr(vote).alias("score")).withColumn("is_secret", F.col("score") >= 0.5)


def digest(scanned: DataFrame) -> DataFrame:
    """The findings without the secrets themselves."""
    return scanned.select("doc_id", "position", F.concat(F.substring("token", 1, 4), F.lit("..."), F.length("token").cast("string")).alias("masked"), F.sha2("token", 256).alias("token_sha256"), F.round("score", 6).alias("score"), "is_secret")


def redact(docs: DataFrame, findings: list[tuple[str, str, str, int]] | None = None) -> DataFrame:
    """docs with every found secret, wherever it stands in its document, replaced by a mark; no row is dropped.

    Works row by row on the words of the text itself, so that no join brings secrets and texts together.
    """
    trees = train(docs.sparkSession, findings or labelled_findings())
    text = F.col("text").cast("string")

    def found(x: Column) -> Column:
        described = F.transform(_tokens(x["word"]), lambda t: F.struct(t.alias("token"), *(c.alias(k) for k, c in features(t, x["word"], x["before"]).items())))
        kept = F.filter(described, lambda y: votes(trees, {k: y[k] for k in FEATURES}) >= 0.5)
        return F.transform(kept, lambda y: F.struct((-F.length(y["token"])).alias("n"), y["token"].alias("token")))

    # longer ones first: one secret may be part of another
    secrets = F.array_sort(F.array_distinct(F.flatten(F.transform(_suspects(text), found))))
    clean = F.aggregate(secrets, text, lambda acc, s: F.replace(acc, s["token"], F.lit(MASK)))
    return docs.withColumn("text", F.coalesce(clean, text))


def votes(trees: list, own: dict[str, Column]) -> Column:
    def walk(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        f, cut, left, right = tree
        return F.when(own[FEATURES[f]] < cut, walk(left)).otherwise(walk(right))

    total = F.lit(0.0)
    for t in trees:
        total = total + walk(t)
    return total / len(trees)
