"""Whole texts to token ids, many texts at a time, in numpy.

``split`` finds the pieces of the public byte-level pattern (contractions, letters, numbers, other, white
space; one space may lead a piece) from character classes alone.  ``PieceEncoder`` keeps each distinct piece's
ids once and spreads them over the texts.  The piece store is emptied when it has ``most`` pieces, so its
memory is bounded however many words a partition has.  A text much longer than a round is cut before a space that
follows something else, which no piece crosses.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Bytes of text in one round of work: about 150 MB of arrays.
CHUNK = 2_000_000
#: Unicode's White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_WORD_END = re.compile(r"\S(?= )")
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, np.uint8)
        for i in range(0x40000):  # planes beyond have neither letters nor numbers
            kind = unicodedata.category(chr(i))[0]
            if kind == "L":
                table[i] = LETTER
            elif kind == "N":
                table[i] = NUMBER
        table[WHITE] = SPACE
        _classes = table
    return _classes


def split(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Starts of all pieces in the code points ``cp`` of texts set end to end; no piece crosses a text's start."""
    n = len(cp)
    kind = classes()[cp]
    is_doc = np.zeros(n + 1, bool)
    is_doc[doc_starts] = True
    is_doc[n] = True
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    run |= is_doc[:n]
    start = run.copy()
    white = kind == SPACE
    ends = np.ones(n, bool)  # last character of its run
    ends[:-1] = run[1:]
    last = white & ends & ~is_doc[1:]  # white space right before something else of the same text
    start |= last
    led = np.zeros(n, bool)  # runs that a space leads
    led[1:] = last[:-1] & (cp[:-1] == 32)
    start &= ~led
    quote = np.flatnonzero((cp == 39) & run & ends & ~led & ~is_doc[1:])
    if len(quote):
        one = cp[quote + 1]
        two = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(is_doc[np.minimum(quote + 2, n)], 0, two)
        short = np.isin(one, [115, 116, 109, 100])  # s t m d
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)  # re ve ll
        hit = short | long
        start[quote[hit] + 1] = False
        after = quote[hit] + np.where(short[hit], 2, 3)
        after = after[after < n]
        start[after] = True  # a run's start already, or the rest of the letters
    return np.flatnonzero(start)


def spread(flat: np.ndarray, offset: np.ndarray, count: np.ndarray, index: np.ndarray) -> np.ndarray:
    """flat[offset[i] : offset[i] + count[i]] for each i of ``index``, end to end."""
    n = count[index]
    total = int(n.sum())
    at = np.repeat(offset[index] - (np.cumsum(n) - n), n)
    at += np.arange(total)
    return flat[at]


class PieceEncoder:
    """``encode``: list of distinct pieces (bytes) -> ids in any order, and where each piece's begin and how many they are."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = 800_000, chunk: int = CHUNK):
        self.encode, self.most, self.chunk = encode, most, chunk
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(base), -1, 2**64))
        self.power, self.inverse = self._powers(base, 1), self._powers(inverse, 1)
        self.base, self.base_inverse = base, inverse
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.offset = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0

    @staticmethod
    def _powers(base: np.uint64, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _add(self, fresh: list[bytes]) -> None:
        ids, at, sizes = self.encode(fresh)
        first, total = len(self.known), self.used + len(ids)
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(fresh) > len(self.offset):
            self.offset = np.concatenate([self.offset, np.zeros_like(self.offset)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.flat[self.used : total] = ids
        self.offset[first : first + len(fresh)] = self.used + at
        self.count[first : first + len(fresh)] = sizes
        self.used = total
        self.known.update(zip(fresh, range(first, first + len(fresh))))

    def _pieces(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of each piece in the store; pieces are told apart by hash, and equal hashes are compared byte by byte."""
        if len(self.power) < len(raw) + 1:
            self.power, self.inverse = self._powers(self.base, len(raw) + 1), self._powers(self.base_inverse, len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)], out=total[1:])
        key = (total[start + size] - total[start]) * self.inverse[start]
        key ^= size.astype(np.uint64) << np.uint64(56)
        _, where, back = np.unique(key, return_index=True, return_inverse=True)
        twin = where[back]
        same = np.array_equal(size, size[twin])
        if same:
            # compare eight bytes at a time is not worth it: the whole text is gathered once
            same = np.array_equal(raw[start[0] : start[-1] + size[-1]], spread(raw, start[twin], size, np.arange(len(start)))) if len(start) else True
        data = raw.tobytes()
        if not same:
            where, back = np.arange(len(start)), np.arange(len(start))
        distinct = [data[a:b] for a, b in zip(start[where].tolist(), (start[where] + size[where]).tolist())]
        if len(self.known) + len(distinct) > self.most:
            self.clear()
        found = list(map(self.known.get, distinct))
        if None in found:
            self._add(list(dict.fromkeys(p for p, i in zip(distinct, found) if i is None)))
            found = list(map(self.known.__getitem__, distinct))
        return np.array(found, np.int64)[back]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (one more at the end)."""
        if not any(len(t) > 2 * self.chunk for t in texts):
            return self._ids(texts)
        found = [np.concatenate([self._ids([part])[0] for part in parts(t, self.chunk)]) for t in texts]
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        text = "".join(texts)
        if not text:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        starts = split(cp, bounds[:-1][lengths > 0])
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        byte = np.concatenate([[0], np.cumsum(width)])
        raw = np.frombuffer(text.encode(), np.uint8)
        begin = byte[starts]
        size = np.diff(np.append(begin, len(raw)))
        index = self._pieces(raw, begin, size)
        made = np.concatenate([[0], np.cumsum(self.count[index])])
        return spread(self.flat, self.offset, self.count, index), made[np.searchsorted(starts, bounds)]


def parts(text: str, most: int = CHUNK) -> Iterator[str]:
    """``text`` in parts of about ``most`` characters that no piece crosses."""
    first = 0
    while len(text) - first > most and (cut := _WORD_END.search(text, first + most)):
        yield text[first : cut.end()]
        first = cut.end()
    yield text[first:]
