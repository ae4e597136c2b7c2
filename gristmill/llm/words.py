"""Vectorised text kernels: words, word hashes and window hashes of whole Arrow batches.

All kernels work on UTF-8 bytes of many documents at once, in slices of bounded size, so
that neither a batch of many rows nor one very long text needs more than a few times its
own bytes. A word is a maximal run of bytes other than U+0020 and U+0009-U+000D.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the two rolling hashes (bytes in a word, words in a window).
BYTE_BASE, WORD_BASE = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: Bytes of text that a kernel looks at together; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 18
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.empty(size, U64)
        have[0] = 1
        have[1:] = base
        np.cumprod(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return U64(pow(int(base), -1, 1 << 64))


BYTE_INV, WORD_INV = inverse(BYTE_BASE), inverse(WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low and high bits are equally random."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64, inv: np.uint64) -> np.ndarray:
    """Hash of values[start:end] for each span; equal spans get equal hashes."""
    prefix = np.empty(len(values) + 1, U64)
    prefix[0] = 0
    np.cumsum(values.astype(U64, copy=False) * powers(base, len(values)), out=prefix[1:])
    raw = (prefix[end] - prefix[start]) * powers(inv, len(values) + 1)[start]
    return mix(raw + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array):
    """Yields (first row, data, offsets from 0) for runs of whole documents of bounded size."""
    data, offsets = text_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, n, lo + 65536)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of True; a run never spans documents."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts, ends = offsets[:-1], offsets[1:]
    some = ends > starts
    first[starts[some]] = inside[starts[some]]
    last[ends[some] - 1] = inside[ends[some] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


class Words:
    """The words of one slice: byte spans, document, hash, and each document's word range."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = lower_ascii(data) if lower else data, offsets
        space = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        self.start, self.end, self.doc = runs(~space, offsets)
        self.hash = spans_hash(self.data.astype(U64) + U64(1), self.start, self.end, BYTE_BASE, BYTE_INV)
        #: first[d] to first[d + 1] are the words of document d.
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)), "left")
        self.count = np.diff(self.first)

    @classmethod
    def sliced(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        """The same of many documents at once, hashed in slices of bounded size."""
        n, lo, parts = len(offsets) - 1, 0, []
        while lo < n:
            hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1), n)
            w = cls(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            parts.append((w.start + offsets[lo], w.end + offsets[lo], w.doc + lo, w.hash))
            lo = hi
        out = cls.__new__(cls)
        out.data, out.offsets = data, offsets
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
        out.start, out.end, out.doc, out.hash = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none
        out.first = np.searchsorted(out.doc, np.arange(n + 1), "left")
        out.count = np.diff(out.first)
        return out

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start (word number) and hash of every run of k words within a document."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.arange(n - k + 1)
        at = at[self.doc[at] == self.doc[at + k - 1]]
        return at, spans_hash(self.hash, at, at + k, WORD_BASE, WORD_INV)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Document and hash of every k-word shingle; a document of fewer words is one shingle."""
        at, h = self.windows(k)
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        whole = spans_hash(self.hash, self.first[short], self.first[short + 1], WORD_BASE, WORD_INV) if len(short) else np.zeros(0, U64)
        return np.concatenate([self.doc[at], short]), np.concatenate([h, whole])


#: Elements that a gathering looks at together.
GATHERED = 1 << 18


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after the other, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    out = np.empty(offsets[-1], data.dtype)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + GATHERED, "right")) - 1)
        if hi == lo + 1:
            out[offsets[lo] : offsets[hi]] = data[start[lo] : end[lo]]
        else:
            shift = np.repeat(start[lo:hi] - offsets[lo:hi], end[lo:hi] - start[lo:hi])
            out[offsets[lo] : offsets[hi]] = data[np.arange(offsets[lo], offsets[hi]) + shift]
        lo = hi
    return out, offsets


def distinct_per_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, h), sorted by both."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]


def sliding(x: np.ndarray, k: int, op) -> np.ndarray:
    """op over every k neighbours of x."""
    width = 1
    while width * 2 <= k:
        x = op(x[:-width], x[width:])
        width *= 2
    return op(x[: len(x) - (k - width)], x[k - width :]) if k > width else x


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[d]:first[d + 1]] for each d."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
