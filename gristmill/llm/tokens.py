"""Token ids of whole texts, with each distinct word tokenized once.

The vocabulary's pre-tokenizer cuts a normalised text into runs of letters, single numbers and
runs of other signs, and drops white space; byte-pair merges never cross such a unit. So the
ids of a text are those of its units, one after the other. Units are found by vectorised
kernels; only those that a worker has not met yet go to the tokenizer, many in one call, with
its start mark between them. A word with an apostrophe, or with a character whose normal form
depends on its neighbours, is a unit as a whole, so that the tokenizer itself decides.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from .letters import CHAR_BASE, CHAR_INV, find
from .words import U64, gather, runs, spans_hash

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Distinct units that a worker keeps (some 40 bytes each); beyond it the worker starts anew.
KEPT_UNITS = 1_500_000
MARK = "<|startoftext|>"
_tables: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: kind; lower case; whether its normal form and kind stand by themselves."""
    if not _tables:
        n = 0x110000
        kind, lower, plain = np.full(n, OTHER, np.uint8), np.arange(n, dtype=np.uint32), np.zeros(n, bool)
        for i in range(n):
            c = chr(i)
            category = unicodedata.category(c)
            if category[0] == "L":
                kind[i] = LETTER
            elif category[0] == "N":
                kind[i] = NUMBER
            elif c.isspace() and i not in range(0x1C, 0x20):
                kind[i] = SPACE
            # Latin, Greek and Cyrillic letters and signs below U+0530; all else is left to the tokenizer
            if i < 0x530 and category[0] in "LNPSZC" and category not in ("Cn", "Lm") and unicodedata.is_normalized("NFC", c) and i not in range(0x1C, 0x20):
                low = c.lower()
                if len(low) == 1 and unicodedata.category(low)[0] == category[0] and c != "'":
                    plain[i], lower[i] = True, ord(low)
        _tables.extend([kind, lower, plain])
    return tuple(_tables)


class UnitTokenizer:
    _kept: dict[str, UnitTokenizer] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(MARK)
        self.hash, self.start, self.length = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0

    @classmethod
    def of(cls, path: str) -> UnitTokenizer:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin."""
        kind_of, lower, plain = tables()
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        kind = kind_of[chars]
        start, end, _ = runs(kind != SPACE, offsets)
        unlike = ~plain[chars]
        unlike[:-1] |= (chars[:-1] == ord("<")) & (chars[1:] == ord("|"))  # might be a special token
        odd = np.concatenate([[0], np.cumsum(unlike)])
        whole = odd[end] > odd[start]
        # within plain words, a unit ends where the kind changes and after each number
        first = np.zeros(len(chars) + 1, bool)
        if len(chars):
            change = np.ones(len(chars), bool)
            change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
            first[:-1] = change & (kind != SPACE)
        first[start] = True
        if whole.any():
            inside = np.zeros(len(chars) + 1, np.int64)
            inside[start[whole]] += 1
            np.add.at(inside, end[whole], -1)
            first[:-1] &= np.cumsum(inside[:-1]) == 0
            first[start] = True
        at = np.flatnonzero(first)
        word = np.searchsorted(start, at, "right") - 1
        stop = np.minimum(np.append(at[1:], len(chars)), end[word]) if len(at) else at
        raw = whole[word]
        folded = lower[chars]
        value = folded.astype(U64) + U64(1)
        if raw.any():
            span = np.zeros(len(chars) + 1, np.int64)
            span[at[raw]] += 1
            np.add.at(span, stop[raw], -1)
            value = np.where(np.cumsum(span[:-1]) > 0, chars.astype(U64) + U64(1 << 22), value)
        h = spans_hash(value, at, stop, CHAR_BASE, CHAR_INV)
        units, where, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hash) + len(units) > KEPT_UNITS:
            self.hash, self.start, self.length, self.used = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        place = find(self.hash, units)
        if (place < 0).any():
            new = place < 0
            self._learn(units[new], chars, at[where[new]], stop[where[new]])
            place = find(self.hash, units)
        length, begin = self.length[place][which], self.start[place][which]
        ids, _ = gather(self.ids, begin, begin + length)
        total = np.concatenate([[0], np.cumsum(length)])
        return ids, total[np.searchsorted(at, offsets)]

    def _learn(self, h: np.ndarray, chars: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        body, at = gather(chars, start, stop)
        text = body.tobytes().decode("utf-32-le", "surrogatepass")
        bounds = at.tolist()
        words = [text[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        parts = []
        for lo in range(0, len(words), 2000):
            own = words[lo : lo + 2000]
            if any("<|" in w for w in own):  # might hold the mark itself
                for w in own:
                    parts.append(np.array([*self.tokenizer.encode(w, add_special_tokens=False).ids, self.mark], np.int64) if MARK not in w else None)
                    if parts[-1] is None:
                        ids = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.int64)
                        ids[ids == self.mark] = -1
                        parts[-1] = np.append(ids, self.mark)
            else:
                parts.append(np.array([*self.tokenizer.encode(MARK.join(own), add_special_tokens=False).ids, self.mark], np.int64))
        ids = np.concatenate(parts)
        cut = np.flatnonzero(ids == self.mark)
        begin, length = np.concatenate([[0], cut[:-1] + 1]), np.diff(np.concatenate([[-1], cut])) - 1
        ids[ids == -1] = self.mark
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        into = np.searchsorted(self.hash, h)
        self.hash = np.insert(self.hash, into, h)
        self.start = np.insert(self.start, into, begin + self.used)
        self.length = np.insert(self.length, into, length)
        self.used += len(ids)
