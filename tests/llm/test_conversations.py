"""Conversation repair against a search over all edits, and against plain counts."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gristmill.llm import conversations as C

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def viable(roles):
    return re.match(r"(s?(ua)*u?)?\Z", roles) is not None


def cheapest(kinds):
    """Cost and least audit by a best-first search over (cost, audit); kinds: (initial, must go, truncated)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        tail = (at, "" if not roles else "s" if roles == "s" else roles[-1])
        if at == len(kinds) and LEGAL.match(roles):
            return cost, audit
        if tail in done:
            continue
        done.add(tail)
        ways = []
        if at < len(kinds):
            initial, gone, cut = kinds[at]
            ways.append((2, "D", 1, ""))
            if not gone:
                ways += [(5 * cut, "K", 1, initial)] * bool(initial) + [(1 + 5 * cut, "R", 1, c) for c in "ua"]
        ways += [(5, "I", 0, c) for c in "ua"]
        for more, edit, step, c in ways:
            if viable(roles + c):
                heapq.heappush(heap, (cost + more, audit + edit, at + step, roles + c))


def test_table_scan_equals_search():
    automaton, rng = C.Automaton(), random.Random(1)
    short = [list(x) for n in range(4) for x in itertools.product([("u", 0, 0), ("a", 0, 0), ("s", 0, 1), ("x", 0, 0), ("u", 1, 0), ("u", 0, 1)], repeat=n)]
    for kinds in short + [[(rng.choice("uuaasx"), rng.random() < 0.1, rng.random() < 0.15) for _ in range(rng.randint(4, 14))] for _ in range(300)]:
        code = bytes(C.GONE if g else 2 * (C.INITIALS + "x").index(i) + t for i, g, t in kinds)
        assert automaton.repair(code) == cheapest(kinds)
    assert len(automaton.vectors) < 40


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = convs.setdefault(conv, [])
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        blank = dup = cut = 0
        seen, kinds = set(), []
        for _, role, text in own:
            real = re.findall(r"[^\x20\x09-\x0D]", text)
            faults = [not real, (role, text) in seen, bool(real) and real[-1] not in ".!?"]
            blank, dup, cut = blank + faults[0], dup + (faults[1] and not faults[0]), cut + (faults[2] and not faults[1])
            seen.add((role, text))
            kinds.append((role[:1], faults[0] or faults[1], faults[2]))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = cheapest(kinds)
        lines, at, roles = [], 0, ""
        for edit in audit:
            due = "a" if roles[-1:] == "u" else "u"
            if edit != "I":
                role, text = own[at][1:]
                at += 1
            if edit == "K":
                roles += role[0]
                lines.append(f"{role}:{text}")
            elif edit in "RI":
                roles += due
                lines.append(f"{'user' if due == 'u' else 'assistant'}:{text if edit == 'R' else ''}")
        out.append((conv, gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def table(seed=2):
    rng, rows = random.Random(seed), []
    texts = ["Hello there.", "yes!", "no", "", "  \n", "What? ", "é ü.", None, "...", "ok.\x85"]
    for conv in range(120):
        rows += [(conv, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)) for t in range(rng.randint(1, 9))]
    rows += [(None, t, "user", f"q {t}.") for t in range(5)] + [(500, None, "user", "x.")] * 3
    rows += [(900, t, ("user", "assistant")[t % 2], f"turn {t % 40}." if t % 3 else "same.") for t in range(600)]
    return rows + [(901, 3, "user", "q" * 60_000 + "."), (902, 7, "system", "only.")]


def result(df):
    return sorted((tuple(r[c.split()[0]] for c in C.FACTS.split(", ")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("held", [C.LARGE_BYTES, 2000])
def test_equals_search(spark, monkeypatch, held):
    monkeypatch.setattr(C, "LARGE_BYTES", held)
    df = spark.createDataFrame(table(), "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("key", "live", "digest", "audit", "nth")})
    assert result(C.repaired_conversations(df.repartition(5))) == brute(table())


def test_all_large(spark, monkeypatch):
    monkeypatch.setattr(C, "LARGE_BYTES", 0)
    rows = [r for r in table(3) if r[0] not in (900,)][:300]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert result(C.repaired_conversations(df)) == brute(rows)


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert result(C.repaired_conversations(df)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert result(C.repaired_conversations(df.limit(0))) == []


def test_without_damage(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi again."), (1, 2, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    (row,) = C.repaired_conversations(df, damage=False).collect()
    assert (row.cost, row.audit, row.illegal) == (2, "DKK", 1)
