"""Byte-level edit distances of many pairs of texts at once.

Columns of the dynamic programme are bit vectors (Myers 1999; blocks of 64 rows
chained as by Hyyro 2003), one pair in each lane of a numpy array, so a step of
numpy advances all pairs by one byte and 64 rows.  What all texts begin and end
with is left out; where what remains of one side has 64 bytes at most, columns
are words of 8 to 64 bits, a distance is counted from the last one's bits, and
texts of the other side go down the tree of their prefixes together.
"""
from __future__ import annotations

from os.path import commonprefix

import numpy as np

#: 64-bit words of byte tables held at once (eight bytes each)
TABLE = 1 << 21
#: lanes of one pass
LANES = 1 << 14
#: bytes of one array of a pass over short texts
PASS = 1 << 18
#: bytes up to which texts are compared with the one before
SHARED = 64
_ONE, _TOP = np.uint64(1), np.uint64(63)


class Texts:
    """Texts laid out for both sides of the programme."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(texts) + b"\0", np.uint8)

    def tables(self, at: np.ndarray, words: int) -> np.ndarray:
        """(word, byte, text): in which of the text's places a byte stands, bit by bit."""
        out = np.zeros((words, 256, len(at)), np.uint64)
        for k, i in enumerate(at.tolist()):
            b = self.bytes[self.start[i] : self.start[i + 1]]
            place = np.arange(len(b))
            np.bitwise_or.at(out[:, :, k], (place >> 6, b), _ONE << (place & 63).astype(np.uint64))
        return out


def _lanes(m: np.ndarray, table: np.ndarray, right: Texts, b: np.ndarray) -> np.ndarray:
    """Distances of the texts of sizes m (above 0) and places in table with the texts b of right, in falling size: (b, m)."""
    n = right.size[b]
    words = len(table)
    score = np.tile(m, (len(b), 1))
    up = np.full((words, len(b), len(m)), ~np.uint64(0))
    down = np.zeros((words, len(b), len(m)), np.uint64)
    last = (m - 1) >> 6
    shift = [np.where(last == w, (m - 1) & 63, 63).astype(np.uint64) for w in range(words)]
    ends = [np.flatnonzero(last == w) for w in range(words)]
    for t in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n, -t, "left"))  # these go on
        byte = right.bytes[right.start[b[:live]] + t]
        plus, minus = _ONE, None
        for w in range(words):
            eq, pv, mv = table[w][byte], up[w, :live], down[w, :live]
            xv = eq | mv
            if minus is not None:
                eq |= minus
            xh = eq & pv
            xh += pv
            xh ^= pv
            xh |= eq
            ph = xh | pv
            np.invert(ph, out=ph)
            ph |= mv
            mh = pv & xh
            more, less = (ph >> shift[w]) & _ONE, (mh >> shift[w]) & _ONE
            ph <<= _ONE
            ph |= plus
            mh <<= _ONE
            if minus is not None:
                mh |= minus
            np.bitwise_and(ph, xv, out=mv)
            xv |= ph
            np.invert(xv, out=xv)
            np.bitwise_or(mh, xv, out=pv)
            if len(ends[w]) == len(m):
                score[:live] += more.view(np.int64) - less.view(np.int64)
            elif len(ends[w]):
                score[:live, ends[w]] += (more[:, ends[w]] - less[:, ends[w]]).view(np.int64)
            plus, minus = more, less
    return score


def _cut(left: list[bytes], right: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Both sides without what all texts begin and end with, which no distance depends on."""
    if not left and not right:
        return left, right
    both = [*left, *right]
    head = len(commonprefix(both))
    tail = len(commonprefix([x[head:][::-1] for x in both]))
    if not head and not tail:
        return left, right
    cut = lambda side: [x[head : len(x) - tail] for x in side]
    return cut(left), cut(right)


class Side:
    """Texts prepared once for tables with many others: as a tree of their prefixes, and, where none is longer than 64 bytes, as bit vectors of places."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.longest = max(map(len, texts), default=0)
        self._tree = self._bits = None

    def tree(self) -> tuple[np.ndarray, Texts, np.ndarray]:
        """(order, texts in that order, how many bytes each begins with like the one before): what texts share is computed once."""
        if self._tree is None:
            order = np.array(sorted(range(len(self.texts)), key=self.texts.__getitem__), np.int64)
            x = Texts([self.texts[i] for i in order.tolist()])
            place = np.arange(min(self.longest, SHARED))
            b = x.bytes[np.minimum(x.start[:-1, None] + place, len(x.bytes) - 1)]
            inside = place < x.size[:, None]
            like = (b[1:] == b[:-1]) & inside[1:] & inside[:-1]
            self._tree = order, x, np.concatenate([[0], np.minimum.accumulate(like, 1).sum(1)])
        return self._tree

    def bits(self) -> tuple[np.ndarray, np.ndarray]:
        """(byte, text): in which of the text's places a byte stands, in the least word that holds all; and which bits of a word a text has."""
        if self._bits is None:
            x = Texts(self.texts)
            word = next(w for w, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if self.longest <= bits)
            table = np.zeros((256, len(self.texts)), word)
            owner = np.repeat(np.arange(len(self.texts)), x.size)
            place = np.arange(len(owner)) - x.start[owner]
            np.bitwise_or.at(table, (x.bytes[: len(owner)], owner), (_ONE << place.astype(np.uint64)).astype(word))
            inside = np.where(x.size > 0, ~np.uint64(0) >> (np.uint64(64) - np.maximum(x.size, 1).astype(np.uint64)), np.uint64(0)).astype(word)
            self._bits = table, inside
        return self._bits


def sides(texts: list[list[bytes]]) -> list[Side]:
    """Lists of texts, without what all begin and end with, prepared for side_table."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).tolist()
    x, _ = _cut([t for own in texts for t in own], [])
    return [Side(x[a:b]) for a, b in zip(at, at[1:])]


def _rows(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return x if len(at) == len(x) and np.array_equal(at, np.arange(len(x))) else x[at]


def _short(left: Side, right: Side, kind: type) -> np.ndarray:
    """Distances of all of left with all of right, none of which is longer than 64 bytes; a prefix that texts of left share is taken once."""
    order, a, like = left.tree()
    table, inside = right.bits()
    word, width = table.dtype.type, len(inside)
    out = np.empty((len(order), width), kind)
    step = max(1, PASS // max(1, width * table.itemsize))
    for at in range(0, len(order), step):
        size, start, shared = a.size[at : at + step], a.start[at : at + step], like[at : at + step].copy()
        shared[0] = 0
        node = np.zeros(len(size), np.int64)  # of each text's prefix
        up, down = np.full((1, width), ~word(0)), np.zeros((1, width), word)
        for t in range(int(size.max()) + 1):
            ended = np.flatnonzero(size == t)
            if len(ended):
                found = np.bitwise_count(_rows(up, node[ended]) & inside).astype(kind)
                found += kind(t)
                found -= np.bitwise_count(_rows(down, node[ended]) & inside)
                out[order[at + ended]] = found
            live = np.flatnonzero(size > t)
            if not len(live):
                break
            new = shared[live] <= t
            first = live[new]
            pv, mv = _rows(up, node[first]), _rows(down, node[first])
            node[live] = np.cumsum(new) - 1
            eq = table[a.bytes[start[first] + t]]
            xh = eq & pv
            xh += pv
            xh ^= pv
            xh |= eq
            eq |= mv
            ph = xh | pv
            np.invert(ph, out=ph)
            ph |= mv
            xh &= pv
            ph += ph
            ph |= word(1)
            xh += xh
            np.bitwise_and(ph, eq, out=mv)
            eq |= ph
            np.invert(eq, out=eq)
            np.bitwise_or(xh, eq, out=pv)
            up, down = pv, mv
    return out


def levenshtein_table(left: list[bytes], right: list[bytes], small: bool = False) -> np.ndarray:
    """Edit distances of all of left with all of right; with small, in the least unsigned type that holds twice any of them."""
    if left and right:
        left, right = _cut(left, right)
    return _table(Side(left), Side(right), small)


def side_table(left: Side, right: Side) -> np.ndarray:
    """levenshtein_table of two of sides, small."""
    if min(left.longest, right.longest) > 64:
        return levenshtein_table(left.texts, right.texts, True)
    return _table(left, right, True)


def _table(left: Side, right: Side, small: bool) -> np.ndarray:
    kind = np.int64 if not small else next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if 2 * (left.longest + right.longest) < np.iinfo(t).max)
    if not left.texts or not right.texts:
        return np.empty((len(left.texts), len(right.texts)), kind)
    if right.longest <= 64:
        return _short(left, right, kind)
    if left.longest <= 64:
        return np.ascontiguousarray(_short(right, left, kind).T)
    return _long(left.texts, right.texts).astype(kind, copy=False)


def _long(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Distances of texts of any length."""
    a, b = Texts(left), Texts(right)
    out = np.empty((len(left), len(right)), np.int64)
    out[a.size == 0] = b.size
    order = np.argsort(a.size, kind="stable")
    order = order[a.size[order] > 0]
    by_size = np.argsort(-b.size, kind="stable")
    at = 0
    while at < len(order):
        # rows of like length share a table
        words = (int(a.size[order[at]]) + 63) >> 6
        most = max(1, min(TABLE // (256 * words), 256))
        to = at + 1
        while to < len(order) and to - at < most and a.size[order[to]] <= 64 * words:
            to += 1
        mine = order[at:to]
        table = a.tables(mine, words)
        step = max(1, LANES // len(mine))
        for c in range(0, len(by_size), step):
            cols = by_size[c : c + step]
            out[np.ix_(mine, cols)] = _lanes(a.size[mine], table, b, cols).T
        at = to
    return out
