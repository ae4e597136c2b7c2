"""LM scoring by a subword lattice: the marginal likelihood of a text over all its segmentations.

The pieces are those of an existing vocabulary; their scores start from the order in which it
ranks them and are re-estimated on the distinct words of the training documents by expectation
maximisation. A word is the word mark and its characters; forward recursion in log space sums
the probability of every way to cut it into pieces. Words that training documents hold are one
more edge of their lattice, from start to end, with the share c / (N + V); the pieces share the
rest, V / (N + V) (c: the word's count, N: all tokens, V: distinct ones). A document is its
words and one end token, all independent.

Words are counted over all training documents: each batch sends its distinct words once to
hashed buckets. A bucket runs the recursion for each distinct word once, however often it
occurs, and answers the blocks of documents that have the word.

Defined cases: a null text is empty: one end token. Rows that share a doc_id count as often as
they occur. Characters that no piece holds cost their bytes' pieces. Without training documents
all counts are 0, and the pieces keep the vocabulary's own scores. Words beyond any length are
scored whole. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .letters import find
from .samples import fold
from .words import U64, BYTE_BASE, BYTE_INV, Words, gather, mix, slices, spans_hash

#: Rounds of expectation maximisation, and what the vocabulary's own scores weigh in them.
ROUNDS, PRIOR = 2, 100.0
WORD_MARK = 0x2581
#: The end token among the words; no word holds white space.
END = b"\n"
_BASE = U64(0x8CB92BA72F3D8DD7)
LN10 = np.log(10.0)


def end_hash() -> np.ndarray:
    data = np.frombuffer(END, np.uint8)
    return spans_hash(data.astype(U64) + U64(1), np.array([0]), np.array([1]), BYTE_BASE, BYTE_INV)


class Pieces:
    """The vocabulary: code points of each piece, and its score; bytes are kept apart."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        names = [sp.id_to_piece(i) for i in usable]
        score = np.array([sp.get_score(i) for i in usable])
        # a rank that the vocabulary gives is read as a frequency by Zipf's law
        rank = np.argsort(np.argsort(-score, kind="stable"), kind="stable")
        self.prior = 1.0 / (rank + 10.0)
        self.prior *= 0.999 / self.prior.sum()
        self.byte = np.log(0.001 / 256)
        self.longest = max(map(len, names))
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, U64), np.zeros(0, np.int64))] * (self.longest + 1)
        for length in range(1, self.longest + 1):
            own = [i for i, name in enumerate(names) if len(name) == length]
            chars = np.array([[ord(c) for c in names[i]] for i in own], np.uint32).reshape(len(own), length)
            h = substring_hash(chars.reshape(-1), np.arange(len(own)) * length, length)
            order = np.argsort(h)
            self.by_length[length] = (h[order], np.array(own, np.int64)[order])


def substring_hash(chars: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    value = np.zeros(len(at), U64)
    for k in range(length):
        value = value * _BASE + chars[at + k].astype(U64) + U64(1)
    return mix(value ^ U64(length << 56))


class Lattice:
    """All pieces at all places of many words."""

    def __init__(self, words: list[bytes], pieces: Pieces):
        text = [chr(WORD_MARK) + w.decode() for w in words]
        length = np.array([len(t) for t in text], np.int64)
        chars = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.concatenate([[0], np.cumsum(length)])
        word = np.repeat(np.arange(len(text)), length)
        left = first[word + 1] - np.arange(len(chars))  # characters to the word's end
        self.node = first[:-1] + np.arange(len(text))  # of each word's start; one node more than characters
        self.last = first[1:] + np.arange(len(text))
        self.nodes = len(chars) + len(text)
        start, size, piece, fixed = [], [], [], []
        for n in range(1, min(pieces.longest, int(length.max(initial=0))) + 1):
            at = np.flatnonzero(left >= n)
            known, ids = pieces.by_length[n]
            hit = find(known, substring_hash(chars, at, n))
            if n == 1:  # a character that is no piece costs its bytes
                miss = at[hit < 0]
                c = chars[miss]
                start.append(miss)
                size.append(np.ones(len(miss), np.int64))
                piece.append(np.full(len(miss), -1))
                fixed.append(pieces.byte * (1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF)))
            at, hit = at[hit >= 0], hit[hit >= 0]
            start.append(at)
            size.append(np.full(len(at), n))
            piece.append(ids[hit])
            fixed.append(np.zeros(len(at)))
        start, size, self.piece, self.fixed = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (start, size, piece, fixed))
        own = word[start] if len(start) else start
        self.tail, self.head = start + own, start + own + size  # nodes
        self.begin, self.end = start - first[own], start - first[own] + size  # places in the word

    def run(self, log_p: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Log marginal of each word; with backward, every edge's posterior too."""
        edge = np.where(self.piece >= 0, log_p[self.piece], self.fixed)
        alpha = self._sweep(edge, self.tail, self.head, self.end, self.node)
        total = alpha[self.last]
        if not backward:
            return total, edge
        beta = self._sweep(edge, self.head, self.tail, -self.begin, self.last)
        word = np.searchsorted(self.node, self.tail, "right") - 1
        return total, np.exp(alpha[self.tail] + edge + beta[self.head] - total[word])

    def _sweep(self, edge, source, target, level, roots) -> np.ndarray:
        """Log-sum over all paths from the roots; edges are taken level by level, the targets of a level together."""
        out = np.full(self.nodes, -np.inf)
        out[roots] = 0.0
        order = np.lexsort((target, level))
        s, t, e = source[order], target[order], edge[order]
        lv = level[order]
        cuts = np.concatenate([[0], np.flatnonzero(lv[1:] != lv[:-1]) + 1, [len(lv)]]) if len(lv) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            v, own = out[s[lo:hi]] + e[lo:hi], t[lo:hi]
            first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            top = np.maximum.reduceat(v, first)
            gap = np.exp(v - np.repeat(top, np.diff(np.append(first, len(v)))))
            out[own[first]] = top + np.log(np.add.reduceat(gap, first))
        return out


#: Bytes of words whose lattices are run together; a longer word makes a lattice of its own.
LATTICE_BYTES = 1 << 18


def lattices(words: list[bytes], pieces: Pieces, most: int = LATTICE_BYTES):
    """Lattices of words one after the other, so many bytes at a time."""
    at = np.concatenate([[0], np.cumsum([len(w) + 3 for w in words])])
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, Lattice(words[lo:hi], pieces)
        lo = hi


def log_marginals(words: list[bytes], pieces: Pieces, log_p: np.ndarray) -> np.ndarray:
    parts = [x.run(log_p)[0] for _, x in lattices(words, pieces)]
    return np.concatenate(parts) if parts else np.zeros(0)


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    body, at = gather(data, start, end)
    return body.tobytes(), np.diff(at).astype(np.uint32)


def _split_words(body: bytes, length: np.ndarray) -> list[bytes]:
    at = np.concatenate([[0], np.cumsum(length.astype(np.int64))]).tolist()
    return [body[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _distinct(column: pa.Array, counted: np.ndarray, all_texts: bool):
    """Hashes, counts in counted documents and (bytes, lengths) of the distinct words; texts of uncounted ones only, unless all_texts."""
    found = []
    for lo, data, offsets in slices(column):
        w = Words(data, offsets, lower=True)
        train = counted[lo + w.doc]
        h, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        n = np.bincount(which, train, len(h)).astype(np.int64)
        own = np.ones(len(h), bool) if all_texts else n == 0
        body, length = _texts(w.data, w.start[first[own]], w.end[first[own]])
        full = np.zeros(len(h), np.uint32)
        full[own] = length
        found.append((h, n, full, body))
    return merge_words(found)


def merge_words(found):
    """Sums counts of equal hashes; the first text there is stays."""
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    h = np.concatenate([f[0] for f in found])
    n = np.concatenate([f[1] for f in found])
    length = np.concatenate([f[2] for f in found]).astype(np.int64)
    body = np.frombuffer(b"".join(bytes(f[3]) for f in found), np.uint8)
    at = np.concatenate([[0], np.cumsum(length)])
    order = np.lexsort((-length, h))
    hs = h[order]
    new = np.concatenate([[True], hs[1:] != hs[:-1]]) if len(hs) else np.zeros(0, bool)
    head = order[new]
    total = np.bincount(np.cumsum(new) - 1, n[order]).astype(np.int64) if len(hs) else n
    text, _ = gather(body, at[head], at[head + 1])
    return h[head], total, length[head].astype(np.uint32), text


def _messages(h, n, length, body, buckets: int):
    at = np.concatenate([[0], np.cumsum(length.astype(np.int64))])
    for b, i in B.split(h, buckets):
        text, _ = gather(body, at[i], at[i + 1])
        yield b, B.pack(h[i], n[i], length[i]) + text.tobytes()


def _read(body: bytes):
    h, n, length = B.unpack(body, "u8", "i8", "u4")
    return h, n, length, body[8 + 20 * len(h) :]


def _count(buckets: int):
    """Words of training documents with counts, from each batch; the end token among them."""

    def f(batches):
        for b in batches:
            train = ~b.column("held_out").to_numpy(zero_copy_only=False)
            column = b.column("text").filter(pa.array(train))
            h, n, length, body = _distinct(column, np.ones(len(column), bool), all_texts=True)
            if len(column):
                h, n, length, body = merge_words([(h, n, length, body), (end_hash(), np.array([len(column)]), np.array([1], np.uint32), END)])
            for bucket, message in _messages(h, n, length, body, buckets):
                yield pa.record_batch({"bucket": pa.array([bucket], pa.int32()), "body": pa.array([message], pa.binary())})

    return f


def _vocabulary(key, table):
    h, n, length, body = merge_words([_read(x) for x in table["body"].to_pylist()])
    end = int(n[h == end_hash()[0]].sum())
    return pa.table({"bucket": [key[0].as_py()], "body": [B.pack(h, n, length) + body.tobytes()], "n": [int(n.sum())], "v": [int((n > 0).sum())], "end": [end]}, pa.schema([("bucket", pa.int32()), ("body", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("end", pa.int64())]))


#: Pieces whose expected numbers travel in one message.
CHUNK = 4096


def _expect(path: str, log_p: np.ndarray):
    """Expected number of each piece in a task's distinct training words: pieces are there for words yet unseen."""

    def f(batches):
        pieces, total = pieces_of(path), np.zeros(len(log_p))
        for batch in batches:
            for body in batch.column("body").to_pylist():
                h, n, length, text = _read(body)
                words = _split_words(text, length)
                words = [words[i] for i in np.flatnonzero((h != end_hash()[0]) & (n > 0))]
                for _, x in lattices(words, pieces):
                    _, posterior = x.run(log_p, backward=True)
                    own = x.piece >= 0
                    total += np.bincount(x.piece[own], posterior[own], len(log_p))
        for lo in range(0, len(total), CHUNK):
            if total[lo : lo + CHUNK].any():
                yield pa.record_batch({"chunk": pa.array([lo // CHUNK], pa.int32()), "body": pa.array([total[lo : lo + CHUNK].tobytes()], pa.binary())})

    return f


def _add(key, table):
    total = np.sum([np.frombuffer(x) for x in table["body"].to_pylist()], axis=0)
    return pa.table({"piece": (key[0].as_py() * CHUNK + np.arange(len(total))).astype(np.int32), "expected": total})


def _ask(buckets: int):
    def f(key, table):
        train = ~table["held_out"].to_numpy(zero_copy_only=False)
        h, n, length, body = _distinct(table["text"], train, all_texts=False)
        # a word with a training occurrence is in the vocabulary; only other words' texts are sent
        return B.asks([(key[0].as_py(), b, m) for b, m in _messages(h, n, length, body, buckets)])

    return f


def _answer(path: str, log_p: np.ndarray, tokens: int, types: int):
    def f(key, asked, known):
        pieces = pieces_of(path)
        h, n, length, body = merge_words([_read(x) for x in known["body"].to_pylist()])
        each = [_read(x) for x in asked["body"].to_pylist()]
        # counts come from the vocabulary; what was asked adds the texts of words it lacks
        h, n, length, body = merge_words([(h, n, length, body.tobytes()), *((e[0], np.zeros(len(e[0]), np.int64), e[2], e[3]) for e in each)])
        log = log_marginals(_split_words(body.tobytes(), length), pieces, log_p)
        if tokens:
            seen = np.log(np.maximum(n, 0.5) / (tokens + types))
            log = np.where(n > 0, np.logaddexp(seen, log + np.log(types / (tokens + types))), log + np.log(types / (tokens + types)))
        out = []
        for block, bucket, e in zip(asked["block"].to_pylist(), asked["bucket"].to_pylist(), each, strict=True):
            at = np.searchsorted(h, e[0])
            out.append((block, bucket, B.pack(n[at], log[at])))
        return pa.table({"block": pa.array([r[0] for r in out], pa.int32()), "bucket": pa.array([r[1] for r in out], pa.int32()), "body": pa.array([r[2] for r in out], pa.binary())})

    return f


def _score(buckets: int, end: int, log_end: float):
    def f(key, table, replies):
        parts, hashes = [], []
        for lo, data, offsets in slices(table["text"]):
            w = Words(data, offsets, lower=True)
            parts.append((lo, w.hash, w.first))
            hashes.append(np.unique(w.hash))
        h = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, U64)
        count, log = np.zeros(len(h), np.int64), np.zeros(len(h))
        answered = dict(zip(replies["bucket"].to_pylist(), replies["body"].to_pylist(), strict=True))
        for b, i in B.split(h, buckets):
            count[i], log[i] = B.unpack(answered[b], "i8", "f8")
        gain = np.log10(count + 1.0)
        out = {c: [] for c in ("n_tokens", "n_known", "log_counts", "score")}
        for _, own, first in parts:
            at = np.searchsorted(h, own)
            n = np.diff(first)
            add = lambda x: np.concatenate([np.add.reduceat(np.append(x, 0), np.minimum(first[:-1], len(x)))]) * (n > 0) if len(n) else np.zeros(0)  # noqa: E731,B023
            out["n_tokens"].append(n + 1)
            out["n_known"].append(add((count[at] > 0).astype(np.int64)) + int(end > 0))
            out["log_counts"].append(add(gain[at]) + np.log10(end + 1.0))
            out["score"].append((add(log[at]) + log_end) / LN10)
        cols = {c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()}
        return pa.table({"doc_id": table["doc_id"], "held_out": table["held_out"], "n_tokens": cols["n_tokens"].astype(np.int64), "n_known": cols["n_known"].astype(np.int64), "log_counts": cols["log_counts"].astype(float), "score": cols["score"].astype(float)})

    return f


def lm_scores(docs: DataFrame, model_file: str, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(F.col("doc_id"), folds) == held).alias("held_out"))
    buckets = B.parts(own)
    sent = own.where(~F.col("held_out")).mapInArrow(_count(buckets), "bucket int, body binary")
    vocabulary = B.checkpointed(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_vocabulary, "bucket int, body binary, n long, v long, end long"))
    n, v, end = (int(x or 0) for x in vocabulary.agg(F.sum("n"), F.sum("v"), F.sum("end")).first())
    pieces = pieces_of(model_file)
    p = pieces.prior
    for _ in range(ROUNDS if n > end else 0):
        got = vocabulary.select("body").mapInArrow(_expect(model_file, np.log(p)), "chunk int, body binary").groupBy("chunk").applyInArrow(_add, "piece int, expected double").collect()
        seen = PRIOR * pieces.prior
        for row in got:
            seen[row.piece] += row.expected
        p = seen / seen.sum() * (1 - 0.001)
    log_end = float(np.log(end / (n + v))) if end else float(np.log(0.1))
    log_p = np.log(p)
    dealt = B.with_block(own, buckets, "doc_id", "text").repartition(buckets, "block")
    asked = dealt.groupBy("block").applyInArrow(_ask(buckets), B.ASK)
    replies = asked.repartition(buckets, "bucket").groupBy("bucket").cogroup(vocabulary.select("bucket", "body").groupBy("bucket")).applyInArrow(_answer(model_file, log_p, n, v), B.ASK)
    scored = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(buckets, end, log_end), "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double")
    base = F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1.0)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
