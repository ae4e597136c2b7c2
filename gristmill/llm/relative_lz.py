"""Substring dedup by relative Lempel-Ziv parsing against every indexed reference block.

Every block of documents is a reference for all others. The index is dealt out by anchors, the
least seed of 10 words within a window: a passage, the run of windows that share an anchor, is
listed in the bucket of its anchor, with its words. Passages whose anchor nobody else has stay at
home. A bucket then parses each passage against all earlier ones of its anchor: a factor starts
at the first window with an earlier occurrence and is extended greedily, word by word, as long as
the source runs on beside it; what follows is looked up again, so that a repeat across the
boundary of two factors is not lost. Back in its block, factors that go on in the same source are
joined, and those of `window` words and more are what is removed.

Hashes only propose: each factor is compared with its source by the words themselves.

A passage that a block has many times is sent once from there. An anchor with more than HOT
occurrences is dealt out further, by its windows, each a passage of its own.

Defined cases: a null or blank text has no words. A text of any length is read whole. Rows that
share a doc_id are parts of one document, in an order that their texts fix; equal rows count as
one earlier than the other. A null doc_id comes before all others. Other columns, whatever their
names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .letters import find
from .words import GATHERED, U64, WORD_BASE, WORD_INV, Words, gather, mix, slices, spans_hash, sliding

#: Words in an anchor; a window of w words has w - SEED + 1 of them.
SEED = 10
#: Windows of a passage, at most (texts that repeat a word for long have long runs of one anchor).
LONGEST = 32
#: Occurrences from which on an anchor is dealt out by windows.
HOT = 5_000
#: A null doc_id.
NONE = -(2**63)


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("text", "ascending")]) if table.num_rows > 1 else table


def _least_seeds(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the seed at every word (all ones where there is none), and the least of each window by its first word."""
    seed = max(1, min(SEED, window))
    at, h = w.windows(seed)
    every = np.full(len(w.hash), U64(2**64 - 1))
    every[at] = h
    return every, sliding(every, window - seed + 1, np.minimum)


def _anchors(table: pa.Table, window: int):
    """Yields the hash of every occurrence of a seed that is the least of a window."""
    many = window - max(1, min(SEED, window)) + 1
    for _, data, offsets in slices(table["text"]):
        w = Words(data, offsets)
        if len(w.hash) < window:
            continue
        every, least = _least_seeds(w, window)
        edge = np.zeros(many - 1, U64)
        reach = np.concatenate([edge, least, edge])
        chosen = every == sliding(reach, many, np.maximum)[: len(every)]
        yield every[chosen & (every != U64(2**64 - 1))]


def _ask_anchors(window: int, buckets: int):
    def f(key, table):
        seen = list(_anchors(table, window))
        if not seen:
            return B.asks([])
        h, n = np.unique(np.concatenate(seen), return_counts=True)
        return B.asks([(key[0].as_py(), b, B.pack(h[i], np.minimum(n[i], 255).astype(np.uint8))) for b, i in B.split(mix(h), buckets)])

    return f


def _answer_anchors(key, table):
    """To each block its anchors that occur twice or more, and whether they are hot."""
    blocks, bodies = table["block"].to_pylist(), table["body"].to_pylist()
    who, (h, n) = B.merged(bodies, "u8", "u1")
    _, group = np.unique(h, return_inverse=True)
    total = np.bincount(group, n)[group]
    out = []
    edges = np.searchsorted(who, np.arange(len(blocks) + 1))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        keep = total[a:b] > 1
        if keep.any():
            out.append((blocks[k], B.pack(h[a:b][keep], total[a:b][keep] > HOT)))
    return B.answers(out)


def _equal(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span are those of the other one."""
    same = end - start == other_end - other
    which = np.flatnonzero(same)
    total = np.concatenate([[0], np.cumsum((end - start)[which])])
    lo = 0
    while lo < len(which):  # so many bytes at a time
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + GATHERED, "right")) - 1)
        i = which[lo:hi]
        own, at = gather(data, start[i], end[i])
        theirs, _ = gather(data, other[i], other_end[i])
        differ = np.concatenate([[0], np.cumsum(own != theirs)])
        same[i] = differ[at[1:]] == differ[at[:-1]]
        lo = hi
    return same


def _first_equal(h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of the first span with the same bytes, by hashes that are checked."""
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    head = first[which]
    later = np.flatnonzero(head != np.arange(len(h)))
    if not _equal(data, start[later], end[later], start[head[later]], end[head[later]]).all():
        seen: dict[bytes, int] = {}
        head = np.array([seen.setdefault(data[a:b].tobytes(), i) for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True))])
    return head


class Passages:
    """The passages of a block's sorted rows that may occur elsewhere, in order: row, position, number of windows, key of the bucket, words."""

    def __init__(self, table: pa.Table, window: int, replies: list[bytes]):
        shared, hot = B.merged(replies, "u8", "?")[1]
        order = np.argsort(shared)
        shared, hot = shared[order], hot[order]
        parts, bodies, base = [], [], 0
        for lo, data, offsets in slices(table["text"]):
            w = Words(data, offsets)
            at, print_ = w.windows(window)
            if not len(at) or not len(shared):
                continue
            anchor = _least_seeds(w, window)[1][at]
            place = find(shared, anchor)
            at, print_, anchor, alone = at[place >= 0], print_[place >= 0], anchor[place >= 0], hot[place[place >= 0]]
            new = alone.copy()
            new[:1] = True
            new[1:] |= (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (w.doc[at[1:]] != w.doc[at[:-1]])
            head = np.flatnonzero(new)
            if not len(head):
                continue
            new |= (np.arange(len(at)) - head[np.cumsum(new) - 1]) % LONGEST == 0
            head = np.flatnonzero(new)
            many = np.diff(np.append(head, len(at)))
            first, last = at[head], at[head] + many - 1 + window
            norm, begin = gather(np.append(w.data, np.uint8(32)), w.start, w.end + 1)  # words and one byte after each
            norm[begin[1:] - 1] = 32
            body, span = gather(norm, begin[first], begin[last] - 1)
            content = mix(spans_hash(w.hash, first, last, WORD_BASE, WORD_INV) ^ mix(anchor[head]))
            key = mix(np.where(alone[head], print_[head], anchor[head]))  # the least hashes have few high bits to deal by
            parts.append((w.doc[first] + lo, first - w.first[w.doc[first]], many, key, content, span[:-1] + base, span[1:] + base))
            bodies.append(body)
            base += len(body)
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2 + (np.zeros(0, np.int64),) * 2
        self.row, self.pos, self.many, self.key, content, self.start, self.end = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none
        self.data = np.concatenate(bodies) if bodies else np.zeros(0, np.uint8)
        #: the first passage of the block with the same words; only these are sent
        self.head = _first_equal(content, self.data, self.start, self.end)
        self.sent = np.flatnonzero(self.head == np.arange(len(self.head)))


def _ask_passages(window: int, buckets: int):
    def f(key, table, replies):
        if not table.num_rows or not replies.num_rows:
            return B.asks([])
        table = _sorted(table)
        p = Passages(table, window, replies["body"].to_pylist())
        ids, tie = table["doc_id"].to_numpy(), table["tie"].to_numpy()
        out = []
        for bucket, i in B.split(p.key[p.sent], buckets):
            own = p.sent[i]
            text, at = gather(p.data, p.start[own], p.end[own])
            # neighbours come one after the other, so ids go as small differences
            head = B.pack(np.diff(ids[p.row[own]], prepend=np.int64(0)), tie[p.row[own]].astype(np.uint32), p.pos[own].astype(np.uint32), np.diff(at).astype(np.uint32))
            out.append((key[0].as_py(), bucket, head + text.tobytes()))
        return B.asks(out)

    return f


def factors(w: Words, window: int, rank: np.ndarray):
    """Greedy parse of each passage (a document of w) against those of lower rank, and its own beginning.

    Returns passage, first window in it, number of windows, source passage, first word there of each factor.
    """
    at, print_ = w.windows(window)
    passage = w.doc[at]
    first_of = np.searchsorted(passage, np.arange(len(w.count) + 1))
    order = np.lexsort((at, rank[passage], print_))
    new = np.concatenate([[True], print_[order][1:] != print_[order][:-1]]) if len(at) else np.zeros(0, bool)
    source = np.empty(len(at), np.int64)
    source[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(at) else order
    found = _greedy(w, window, at, passage, first_of, source)
    p, j, many, s = found
    word, other = at[j], at[s]
    if not _equal(w.data, w.start[word], w.end[word + window + many - 2], w.start[other], w.end[other + window + many - 2]).all():
        # two texts with one hash: windows are told apart by their words, and each is a factor of its own
        seen: dict[bytes, int] = {}
        for i in np.lexsort((at, rank[passage])).tolist():
            source[i] = seen.setdefault(w.data[w.start[at[i]] : w.end[at[i] + window - 1]].tobytes(), i)
        j = np.flatnonzero(source != np.arange(len(at)))
        p, many, s = passage[j], np.ones(len(j), np.int64), source[j]
    return p, j - first_of[p], many, passage[s], at[s] - w.first[passage[s]]


def _greedy(w: Words, window: int, at: np.ndarray, passage: np.ndarray, first_of: np.ndarray, source: np.ndarray):
    n = len(at)
    known = np.where(source != np.arange(n), np.arange(n), n)
    ahead = np.append(np.minimum.accumulate(known[::-1])[::-1], n)  # the next window with an earlier occurrence
    p, here = np.arange(len(first_of) - 1), first_of[:-1]
    out = []
    while len(p):
        j = ahead[here]
        some = j < first_of[p + 1]
        p, j = p[some], j[some]
        s = source[j]
        mine, theirs = at[j] + window, at[s] + window  # the first words after the window
        stop, other_stop = w.first[p + 1], w.first[passage[s] + 1]
        more, going = np.zeros(len(j), np.int64), np.arange(len(j))
        while len(going):
            a, b = mine[going] + more[going], theirs[going] + more[going]
            inside = (a < stop[going]) & (b < other_stop[going])
            going, a, b = going[inside], a[inside], b[inside]
            going = going[w.hash[a] == w.hash[b]]
            more[going] += 1
        out.append((p, j, more + 1, s))
        here = j + more + 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _parse(window: int):
    """A bucket: all passages of its anchors, parsed in the order of their places; each block gets its factors."""

    def f(key, table):
        table = table.sort_by("block")
        blocks, bodies = table["block"].to_pylist(), table["body"].to_pylist()
        each = [B.unpack(b, "i8", "u4", "u4", "u4") for b in bodies]
        doc = np.concatenate([np.cumsum(e[0]) for e in each])
        tie, pos, length = (np.concatenate([e[i] for e in each]) for i in (1, 2, 3))
        edges = np.concatenate([[0], np.cumsum([len(e[0]) for e in each])])
        data = np.frombuffer(b"".join(memoryview(b)[8 + 20 * len(e[0]) :] for b, e in zip(bodies, each, strict=True)), np.uint8)
        w = Words.sliced(data, np.concatenate([[0], np.cumsum(length, dtype=np.int64)]))
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((tie, doc))] = np.arange(len(doc))  # stable: then by block, and in its order
        p, start, many, source, word = factors(w, window, rank)
        order = np.argsort(p, kind="stable")
        p, start, many, source, word = (x[order] for x in (p, start, many, source, word))
        cut = np.searchsorted(p, edges)
        out = []
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                own = slice(a, b)
                out.append((blocks[k], key[0].as_py(), B.pack((p[own] - edges[k]).astype(np.uint32), start[own].astype(np.uint8), many[own].astype(np.uint8), np.diff(doc[source[own]], prepend=np.int64(0)), (pos[source[own]].astype(np.int64) + word[own]).astype(np.uint32))))
        return B.asks(out)

    return f


def _joined(row, start, many, source, source_pos):
    """Factors (row, first word, windows, source, first word there) in order, with those that go on in the same source joined."""
    order = np.lexsort((start, row))
    row, start, many, source, source_pos = (x[order] for x in (row, start, many, source, source_pos))
    if not len(row):
        return row, start, many, source, source_pos
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + many[:-1]) | (source[1:] != source[:-1]) | (source_pos[1:] - source_pos[:-1] != many[:-1])
    at = np.flatnonzero(new)
    return row[at], start[at], np.add.reduceat(many, at), source[at], source_pos[at]


def _block_factors(table: pa.Table, window: int, buckets: int, anchors: list[bytes], replies: dict[int, bytes]):
    """All factors of the sorted block, those with a source in it and those that the buckets have found."""
    p = Passages(table, window, anchors)
    ids = table["doc_id"].to_numpy()
    again = np.flatnonzero(p.head != np.arange(len(p.head)))
    head = p.head[again]
    parts = [(p.row[again], p.pos[again], p.many[again], ids[p.row[head]], p.pos[head])]
    for bucket, i in B.split(p.key[p.sent], buckets):
        if bucket in replies:
            number, start, many, doc, pos = B.unpack(replies[bucket], "u4", "u1", "u1", "i8", "u4")
            own = p.sent[i[number]]
            parts.append((p.row[own], p.pos[own] + start, many.astype(np.int64), np.cumsum(doc), pos.astype(np.int64)))
    return _joined(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _finish(window: int, buckets: int, with_text: bool):
    def f(key, table, replies):
        table = _sorted(table)
        step, bucket, body = (replies[c].to_pylist() for c in ("step", "bucket", "body"))
        anchors = [x for s, x in zip(step, body, strict=True) if s == 1]
        found = {b: x for s, b, x in zip(step, bucket, body, strict=True) if s == 2}
        row, start, many, source, source_pos = _block_factors(table, window, buckets, anchors, found)
        length = many + window - 1
        edges = np.searchsorted(row, np.arange(table.num_rows + 1))
        n_words, n_removed, digest, kept_text, spans = [], [], [], [], []
        for i, text in enumerate(table["text"]):
            words = (text.as_py() or "").encode().split()
            n_words.append(len(words))
            lo, hi = edges[i], edges[i + 1]
            if hi > lo:
                gone = np.zeros(len(words) + 1, np.int32)
                np.add.at(gone, start[lo:hi], 1)
                np.add.at(gone, start[lo:hi] + length[lo:hi], -1)
                keep = np.cumsum(gone[:-1]) == 0
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            kept = b" ".join(words)
            n_removed.append(n_words[-1] - len(words))
            digest.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_text.append(kept.decode())
                spans.append([{"start": int(start[k]), "length": int(length[k]), "source_id": None if source[k] == NONE else int(source[k]), "source_start": int(source_pos[k])} for k in range(lo, hi)])
        out = {"doc_id": table["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if with_text:
            out["kept_text"] = pa.array(kept_text, pa.string())
            kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source_id", pa.int64()), ("source_start", pa.int64())])
            out["factors"] = pa.array(spans, pa.list_(kind))
        return pa.table(out)

    return f


def substring_dedup(docs: DataFrame, window: int = 20, with_text: bool = True) -> DataFrame:
    """Removes the words of every `window`-word passage that starts earlier in the corpus.

    docs needs doc_id (integer) and text. Returns doc_id, n_words, n_removed, kept_sha256 and,
    with_text, kept_text and factors (start, length, source_id, source_start in words).
    """
    text = F.col("text").cast("string")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), text.alias("text"), (F.xxhash64(text).bitwiseAND(F.lit(2**32 - 1))).alias("tie"))
    n = B.parts(own)
    own = B.with_block(own, n, "doc_id", "tie").repartition(n, "block")
    anchors = own.groupBy("block").applyInArrow(_ask_anchors(window, n), B.ASK).repartition(n, "bucket").groupBy("bucket").applyInArrow(_answer_anchors, B.ANSWER)
    passages = own.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(_ask_passages(window, n), B.ASK)
    parsed = passages.repartition(n, "bucket").groupBy("bucket").applyInArrow(_parse(window), B.ASK)
    replies = anchors.select("block", F.lit(None).cast("int").alias("bucket"), "body", F.lit(1).alias("step")).unionAll(parsed.withColumn("step", F.lit(2)))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string, factors array<struct<start:long,length:long,source_id:long,source_start:long>>" if with_text else "")
    out = own.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_finish(window, n, with_text), schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NONE, F.col("doc_id")))
