"""Best-fit packing by sum of squares.

Documents become token ids and an end mark; only those longer than a sequence are cut. A group
of pieces is packed by the sum-of-squares rule: N(g) counts the open bins with gap g, and each
piece goes where the sum of N(g)**2 over all gaps becomes smallest, be it an open bin or a new
one; a full bin is closed and no longer counts. Pieces beyond a part of the capacity go first,
larger ones earlier, the others in a shuffled order, so that small ones of all lengths are there
to fill what is left. What a pass leaves open is packed again by the same rule, with as many full
bins, until the number of bins is the least that the lengths allow or PASSES are over. Groups have a bounded number of
pieces, so any number of groups is packed at once; a group of GROUP pieces wastes a bin or two in
thousands.

A piece's group hangs on the piece itself, its task's number and how many equal ones the task has
had, not on the order of the input, so a task that runs again deals alike.

Tokens come from tokens.UnitTokenizer, which asks the tokenizer once for each distinct word.

Defined cases: a null or empty text is the end mark alone. Repeated rows are packed each. A
text of any length is cut into pieces of whole sequences and a rest. Other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed
from .letters import find
from .tokens import UnitTokenizer
from .words import U64, mix

#: Pieces that are packed together.
GROUP = 20_000
#: Orders that passes take in turn: pieces of at least this part of the capacity go by size; and passes over what is open.
PARTS, PASSES = (0.0, 1 / 8, 1 / 16, 1 / 4), 24
#: Characters of text that are tokenized together; a longer text is taken alone.
GROUP_CHARS = 1 << 18
END = 0


def text_groups(column: pa.Array):
    """Yields texts (a null is empty) in runs of bounded size."""
    held, size = [], 0
    for x in column:
        t = x.as_py() or ""
        if held and size + len(t) > GROUP_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


class Seen:
    """How many equal values there were before each one."""

    def __init__(self):
        self.known, self.many = np.zeros(0, U64), np.zeros(0, np.int64)

    def before(self, h: np.ndarray) -> np.ndarray:
        values, which, many = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(which, kind="stable")
        first = np.cumsum(many) - many
        nth = np.empty(len(h), np.int64)
        nth[order] = np.arange(len(h)) - first[which[order]]
        at = find(self.known, values)
        nth += np.where(at >= 0, self.many[at] if len(self.many) else 0, 0)[which]
        self.many[at[at >= 0]] += many[at >= 0]
        known = np.concatenate([self.known, values[at < 0]])
        order = np.argsort(known)
        self.known, self.many = known[order], np.concatenate([self.many, many[at < 0]])[order]
        return nth


def cut(path: str, length: int, with_ids: bool):
    def f(batches):
        tokenizer, seen, task = UnitTokenizer.of(path), Seen(), TaskContext.get()
        task = U64(task.partitionId() if task else 0)
        for batch in batches:
            row = 0
            for texts in text_groups(batch.column("text")):
                ids, first = tokenizer.encode(texts)
                ids = np.insert(ids, first[1:], END).astype("<u4")
                first = first + np.arange(len(first))
                pieces = -(-np.diff(first) // length)
                at = np.repeat(np.arange(len(texts)), pieces)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * length
                many = np.minimum(length, np.diff(first)[at] - start)
                whole = memoryview(ids.tobytes())
                lo = ((first[at] + start) * 4).tolist()
                parts = [whole[a : a + 4 * n] for a, n in zip(lo, many.tolist(), strict=True)]
                crc = np.array([zlib.crc32(p) for p in parts], np.int64)
                ids_of = batch.column("doc_id").fill_null(0).to_numpy().view(U64)[at + row]
                own = mix(mix(ids_of + U64(1)) ^ crc.astype(U64) ^ (piece.astype(U64) << U64(32)))
                salt = mix(own ^ mix(seen.before(own).astype(U64) + (task << U64(40))))
                out = {"doc_id": batch.column("doc_id").take(pa.array(at + row)), "piece": piece.astype(np.int32), "start": start, "length": many, "ids_crc32": crc, "salt": (salt >> U64(1)).astype(np.int64)}
                row += len(texts)
                yield pa.record_batch(out | ({"ids": pa.array([bytes(p) for p in parts], pa.binary())} if with_ids else {}))

    return f


def sum_of_squares(lengths: list[int], capacity: int, sparing: bool = False) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, taken in the order given; every length is at most the capacity.

    sparing: a new bin is opened only for a piece that fits no open one.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_: dict[int, list[int]] = {}
    bins, bin_of, offset = 0, [], []
    never = np.int64(2**60)
    for s in lengths:
        best, gap = (2 * int(count[capacity - s]) + 1 if s < capacity else 0), capacity
        if s < capacity:
            n = count[s:capacity]
            cost = np.where(n > 0, 2 * (count[: capacity - s] - n + 1), never)
            cost[0] -= n[0] > 0  # an exact fit closes the bin
            k = int(cost.argmin())
            if cost[k] <= best or (sparing and cost[k] < never):
                gap = s + k
        if gap < capacity:
            b = open_[gap].pop()
            count[gap] -= 1
        else:
            b, bins = bins, bins + 1
        bin_of.append(b)
        offset.append(capacity - gap)
        if gap > s:
            open_.setdefault(gap - s, []).append(b)
            count[gap - s] += 1
    return bin_of, offset


def pack_group(lengths: np.ndarray, capacity: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; the pieces are taken in the order that passes ask for."""
    rng = np.random.default_rng(seed)
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins, least = None, -(-int(lengths.sum()) // capacity)
    for number in range(PASSES + 1):
        if bins is None:
            mine = np.arange(len(lengths))
        else:  # what is open, and as many full bins by chance
            full = np.bincount(bin_of, lengths, bins) == capacity
            some = ~full
            some[rng.permutation(np.flatnonzero(full))[: int((~full).sum())]] = True
            mine = np.flatnonzero(some[bin_of])
        large = lengths[mine] >= max(1, PARTS[number % len(PARTS)] * capacity)
        order = np.concatenate([mine[large][np.argsort(-lengths[mine[large]], kind="stable")], rng.permutation(mine[~large])])
        found, at = (np.array(x, np.int64) for x in sum_of_squares(lengths[order].tolist(), capacity, sparing=number % 8 < 4))
        many = int(found.max(initial=-1)) + 1
        if bins is None:
            names = np.arange(many)
        else:
            names = np.unique(bin_of[mine])
            if many > len(names):
                continue
        bin_of[order], offset[order] = names[found], at
        bin_of = np.unique(bin_of, return_inverse=True)[1]
        bins = int(bin_of.max(initial=-1)) + 1
        if bins <= least:
            break
    return bin_of, offset


def _pack(capacity: int, with_ids: bool):
    def f(key, table):
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bin_of, offset = pack_group(table["length"].to_numpy(), capacity)
        out = {c: table[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        out["sequence_id"] = pa.array(bin_of + (np.int64(key[0].as_py()) << 32))
        out["offset"] = pa.array(offset, pa.int64())
        return pa.table(out | ({"ids": table["ids"]} if with_ids else {}))

    return f


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece; with_ids adds its ids."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, "
    pieces = checkpointed(own.mapInArrow(cut(tokenizer_path, capacity, with_ids), fields + "salt long" + (", ids binary" if with_ids else "")))
    groups = max(1, -(-pieces.count() // group))
    pieces = pieces.withColumn("group", (F.col("salt") % groups).cast("int")).drop("salt")
    return pieces.groupBy("group").applyInArrow(_pack(capacity, with_ids), fields + "sequence_id long, offset long" + (", ids binary" if with_ids else ""))
