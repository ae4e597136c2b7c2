"""Conversation structure repair by a lazily determinised weighted automaton.

The edits of a conversation (keep, rerole, delete, insert) that make its roles read `(s?(ua)+)?` are
paths of a weighted automaton with four states: nothing yet, after s, after u, after a. Read from the last
row to the first, a set of paths is a vector of costs, one for each state: what is still to be paid
from there to the end. Such a vector less its least cost is a state of the determinised automaton;
there are few, as costs of states differ by a few insertions at most. They are numbered as they
are met, and so are the transitions (state, kind of row), which are kept in a table. A conversation is then a scan
of this table, and the weights of its transitions add up to the cost.

The edits are read in the other direction, from the first row on: of the arcs that are tight (cost
of the arc and what is to be paid after it make what is to be paid before it) the ASCII-least is taken,
which gives the ASCII-least of all cheapest edits. Tight arcs are part of the table.

Rows are shuffled once, by conversation, and sorted. A conversation is held in memory up to
LARGE_BYTES of text. Larger ones, which are few, take a way of their own: duplicates are marked by all tasks
(a digest's first turn, pre-aggregated and joined; a digest that very many rows share is
broadcast), their rows stream through a task that keeps two bytes a row, and a second time to be hashed.
The digest of a whole conversation cannot be computed in parts, so one task reads its rows
in order.

Defined cases: null roles and texts are one space, and so is a null conv_id or turn in the damaged
key. Rows with equal turns, null ones first, are taken by role, then text. Rows with a null conv_id
are one conversation. A role is judged by its first character; an empty role fits nowhere. Very long
texts are read whole, and repeated rows are duplicates. Columns other than conv_id, turn, role
and text, whatever their names, are not read. A conversation that damage leaves no rows has zeros,
an empty audit and the hash of an empty string. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BROADCAST_ROWS, checkpointed, join_by_hot_key

#: Text of a conversation that is held in memory.
LARGE_BYTES = 16 << 20
#: Costs of the edits, of a truncated row that stays, and characters.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
WHITE, STOPS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"
NAMES = {"u": "user", "a": "assistant"}
#: What each state may read, and the state after it.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
FAR = 1 << 40
#: Kinds of rows: one that must go, else the role's initial (or another) and whether it is truncated.
GONE = 8
INITIALS = "usa"

FACTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Automaton:
    """The determinised automaton, as far as it has been asked for."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, int], int] = {}
        self.steps: list[tuple[int, int, tuple]] = []  # state after, weight, tight edits from each state
        end = self._inserted([0 if q in ENDS else FAR for q in range(4)])
        self.end, self.base = self._number(end)
        self.tail = tuple(self._tight(None, end, end, q)[0] for q in range(4))

    @staticmethod
    def _inserted(v: list[int]) -> list[int]:
        for _ in range(3):
            v = [min(own, *(INSERT + v[NEXT[q][c]] for c in NAMES if c in NEXT[q])) for q, own in enumerate(v)]
        return v

    def _number(self, v: list[int]) -> tuple[int, int]:
        least = min(v)
        own = tuple(x - least for x in v)
        if own not in self.numbers:
            self.numbers[own] = len(self.vectors)
            self.vectors.append(own)
        return self.numbers[own], least

    @staticmethod
    def _arcs(kind: int, q: int) -> Iterator[tuple[str, int, int]]:
        """Edit, cost and state after it of each way past a row."""
        yield "D", DELETE, q
        if kind != GONE:
            initial, more = (*INITIALS, "")[kind >> 1], TRUNCATED * (kind & 1)
            if initial in NEXT[q]:
                yield "K", more, NEXT[q][initial]
            for c in NAMES:
                if c in NEXT[q]:
                    yield "R", RENAME + more, NEXT[q][c]

    def _tight(self, kind: int | None, now: list[int], after, q: int) -> tuple[str, int]:
        """The ASCII-least cheapest edits up to and with a row (or the end), and the state after them."""
        edits = ""
        while kind is not None or now[q]:
            ways = [(e, r) for e, cost, r in (self._arcs(kind, q) if kind is not None else ()) if cost + after[r] == now[q]]
            ways += [("I", NEXT[q][c]) for c in NAMES if c in NEXT[q] and INSERT + now[NEXT[q][c]] == now[q]]
            edit, q = min(ways)
            edits += edit
            if edit != "I":
                break
        return edits, q

    def step(self, state: int, kind: int) -> int:
        """The number of the transition from a state, by a row before it."""
        key = (state, kind)
        if key not in self.table:
            after = self.vectors[state]
            now = self._inserted([min(cost + after[r] for _, cost, r in self._arcs(kind, q)) for q in range(4)])
            self.table[key] = len(self.steps)
            self.steps.append((*self._number(now), tuple(self._tight(kind, now, after, q) for q in range(4))))
        return self.table[key]

    def repair(self, kinds: bytes | bytearray) -> tuple[int, str]:
        """Cost and audit of a conversation, given the kinds of its rows."""
        state, cost, path = self.end, self.base, array("H")
        for kind in reversed(kinds):
            number = self.table.get((state, kind))
            if number is None:
                number = self.step(state, kind)
            state, weight, _ = self.steps[number]
            cost += weight
            path.append(number)
        cost += self.vectors[state][0]
        q, edits = 0, []
        for number in reversed(path):
            edit, q = self.steps[number][2][q]
            edits.append(edit)
        return cost, "".join(edits) + self.tail[q]


class Replay:
    """The repaired rows that an audit makes of the rows of a conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.q = audit, 0, 0

    def _new_role(self) -> str:
        c = next(c for c in NAMES if c in NEXT[self.q])
        self.q = NEXT[self.q][c]
        return NAMES[c]

    def inserted(self) -> Iterator[str]:
        while self.audit.startswith("I", self.at):
            self.at += 1
            yield self._new_role() + ":"

    def row(self, role: str, text: str) -> Iterator[str]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.q = NEXT[self.q][role[0]]
            yield f"{role}:{text}"
        elif edit == "R":
            yield f"{self._new_role()}:{text}"


class Digest:
    """SHA-256 of lines joined by newlines."""

    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def add(self, lines) -> None:
        for line in lines:
            self.sha.update(("\n" if self.some else "").encode() + line.encode())
            self.some = True


class Tally:
    """Faults and kinds of the rows of a conversation, as they come in order."""

    def __init__(self):
        self.kinds = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.least = self.most = self.before = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            self.distinct += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        real = text.rstrip(WHITE)
        cut = bool(real) and real[-1] not in STOPS
        if not real:
            self.blank += 1
        elif seen:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        self.kinds.append(GONE if not real or seen else 2 * (INITIALS.index(initial) if initial and initial in INITIALS else 3) + cut)

    def facts(self, automaton: Automaton) -> dict:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.distinct
        cost, audit = automaton.repair(self.kinds)
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}


_TYPES = {"conv_id": pa.int64(), **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch({k: pa.array([r.get(k) for r in rows], t) for k, t in _TYPES.items()})


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator]]:
    """Conversations of sorted rows; each row is the tuple of the columns after conv_id."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for conv, own in itertools.groupby(rows(), key=lambda r: r[0]):
        yield conv, (r[1:] for r in own)


def _flushed(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for r in records:
        out.append(r)
        size += 200 + len(r.get("audit") or "")
        if size > 4 << 20:
            yield _batch(out)
            out, size = [], 0
    if out:
        yield _batch(out)


def _whole(most: int):
    """Conversations of up to so many bytes; of a larger one only the id, without a hash."""

    def run(batches):
        automaton = Automaton()

        def records():
            for conv, rows in _groups(batches):
                tally, held, seen, size = Tally(), [], set(), 0
                for turn, role, text, live in rows:
                    if live:
                        size += 64 + len(role) + len(text)
                        if size > most:
                            held = None
                            break
                        tally.add(turn, role, text, (role, text) in seen)
                        seen.add((role, text))
                        held.append((role, text))
                if held is None:
                    yield {"conv_id": conv}
                    continue
                facts, digest = tally.facts(automaton), Digest()
                replay = Replay(facts["audit"])
                for role, text in held:
                    digest.add(replay.row(role, text))
                digest.add(replay.inserted())
                yield facts | {"conv_id": conv, "repaired_sha256": digest.sha.hexdigest()}

        yield from _flushed(records())

    return run


def _streamed(batches):
    """Facts and audits of conversations of any length, without a hash."""
    automaton = Automaton()

    def records():
        for conv, rows in _groups(batches):
            tally, before = Tally(), None
            for turn, role, text, later in rows:
                tally.add(turn, role, text, later or (role, text) == before)
                before = (role, text)
            yield tally.facts(automaton) | {"conv_id": conv}

    yield from _flushed(records())


def _hashed(batches):
    """The hash of each conversation: its audit comes first, then its rows."""

    def records():
        for conv, rows in _groups(batches):
            _, _, _, audit = next(rows)
            replay, digest = Replay(audit), Digest()
            for _, role, text, _ in rows:
                digest.add(replay.row(role, text))
            digest.add(replay.inserted())
            yield {"conv_id": conv, "repaired_sha256": digest.sha.hexdigest()}

    yield from _flushed(records())


def damaged(rows: DataFrame, damage: bool = True) -> DataFrame:
    """conv_id, turn, role, text and live of all rows after damage; dropped rows stay as rows that are not live."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    key = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    fate = F.crc32(key) % 20 if damage else F.lit(-1)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    own = rows.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 0, "").when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") != 0).alias("live"), twice.alias("nth")).drop("nth")


def _in_order(rows: DataFrame, *columns: Column | str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", *columns)


def _large(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The result for the conversations in ids, however long they are."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    few = F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids
    own = rows.where("live").withColumn("key", key).join(few, "key", "left_semi")
    own = own.select("key", "conv_id", "turn", "role", "text", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("digest"))
    first = F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first")
    firsts = checkpointed(own.groupBy("key", "digest").agg(first, F.count(F.lit(1)).alias("copies")))
    own = join_by_hot_key(own, firsts, ["key", "digest"], "copies")
    own = checkpointed(own.select("conv_id", "turn", "role", "text", (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("later")))
    facts = checkpointed(_in_order(own, "turn", "role", "text").mapInArrow(_streamed, FACTS))
    audits = facts.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit", F.lit(0).alias("nth"))
    rows = own.select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("nth"))
    hashes = _in_order(audits.unionAll(rows), "nth", "turn", "role", "text").drop("nth").mapInArrow(_hashed, FACTS)
    hashes = hashes.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("repaired_sha256").alias("sha"))
    return facts.withColumn("key", key).join(hashes, "key").withColumn("repaired_sha256", F.col("sha")).drop("key", "sha")


def repaired_conversations(rows: DataFrame, damage: bool = True) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation (conv_id, turn, role, text).

    damage: whether rows are damaged first, by a checksum of conv_id and turn.
    """
    rows = damaged(rows, damage)
    done = checkpointed(_in_order(rows, "turn", "role", "text").mapInArrow(_whole(LARGE_BYTES), FACTS))
    left = done.where("repaired_sha256 IS NULL").select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"))
    done = done.where("repaired_sha256 IS NOT NULL")
    return done.unionByName(_large(rows, left)) if left.limit(1).count() else done
