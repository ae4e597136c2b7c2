"""Words of letters, lower-cased, and their character n-grams, for whole slices of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import U64, gather, mix, runs, spans_hash

#: Code points of text that are looked at together; a longer text makes a slice of its own.
SLICE_CHARS = 1 << 17
CHAR_BASE = U64(0xC2B2AE3D27D4EB4F)
CHAR_INV = U64(pow(int(CHAR_BASE), -1, 1 << 64))
_alpha: list[np.ndarray] = []


def alpha() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _alpha:
        _alpha.append(np.array([chr(i).isalpha() for i in range(0x110000)], bool))
    return _alpha[0]


def text_slices(column: pa.Array, most: int = SLICE_CHARS):
    """Yields (first row, lower-cased texts) for runs of whole documents of bounded size."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lo, held, size = 0, [], 0
    for i in range(len(column)):
        t = column[i].as_py() or ""
        if held and size + len(t) > most:
            yield lo, held
            lo, held, size = i, [], 0
        held.append(t.lower())
        size += len(t)
    if held:
        yield lo, held


class LetterWords:
    """The distinct letter words of a slice, and which of them each document has."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        start, end, self.doc = runs(alpha()[chars], offsets)
        h = spans_hash(chars.astype(U64) + U64(1), start, end, CHAR_BASE, CHAR_INV)
        #: hash of each distinct word; which of them each running word is; the words with < and > around
        self.hash, first, self.which = np.unique(h, return_index=True, return_inverse=True)
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))
        body, at = gather(chars, start[first], end[first])
        length = np.diff(at)
        self.offsets = at + 2 * np.arange(len(at))
        self.chars = np.empty(self.offsets[-1], np.uint32)
        mark = np.ones(len(self.chars), bool)
        mark[self.offsets[:-1]] = mark[self.offsets[1:] - 1] = False
        self.chars[mark] = body
        self.chars[self.offsets[:-1]], self.chars[self.offsets[1:] - 1] = 60, 62
        self.length = length

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct word and hash of each of its n-grams, the boundary marks included."""
        if len(self.chars) < n:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        word = np.repeat(np.arange(len(self.hash)), np.diff(self.offsets))
        at = np.arange(len(self.chars) - n + 1)
        at = at[word[at] == word[at + n - 1]]
        value = np.zeros(len(at), U64)
        for k in range(n):
            value = value * CHAR_BASE + self.chars[at + k].astype(U64) + U64(1)
        return word[at], mix(value ^ U64(n * 0x9FB21C651E98DF25 & (2**64 - 1)))


def find(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted known ones, or -1."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)
