"""FM-index over a shard's word sequences, searched many patterns at a time.

The Burrows-Wheeler transform of the shard's segments (dense word numbers, 0
closing each segment) is kept as a wavelet matrix of packed bit rows with
sampled ranks (Claude, Navarro and Ordonez, 2015): sigma words take n * log2
sigma bits.  Suffixes are sorted by prefix doubling to a fixed depth, which is
all that searches of patterns up to that depth can tell apart.

`matching_statistics` streams patterns from their right ends: backward steps
while they succeed, and, when one fails or the depth is reached, a step to the
enclosing interval of a shorter match (Ohlebusch, Gog and Kuegel, 2010).
"""
from __future__ import annotations

import numpy as np


class WaveletMatrix:
    def __init__(self, values: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.n = len(values)
        self.rows, self.zeros = [], []
        now = values.astype(np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> np.uint32(level)) & np.uint32(1) == 1
            words = np.packbits(bit, bitorder="little")
            words = np.concatenate([words, np.zeros(-len(words) % 8 + 8, np.uint8)]).view(np.uint64)
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.rows.append((words, ranks))
            self.zeros.append(int(self.n - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        self.base = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (words, ranks), zeros in zip(range(self.bits - 1, -1, -1), self.rows, self.zeros):
            word = at >> 6
            below = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = ranks[word] + np.bitwise_count(below)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first `at` values."""
        return self._walk(symbol, at) - self.base[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, depth: int):
        """text: symbols 1.. with 0 closing each segment; depth: longest match of interest."""
        self.n, self.depth = len(text), depth
        text = text.astype(np.int32)
        sigma = int(text.max(initial=0)) + 1
        #: ranks of suffixes by their first 1, 2, 4, ... symbols
        self.ranks = {1: text}
        size = 1
        while True:
            have = self.ranks[size]
            key = have.astype(np.int64) * (int(have.max(initial=0)) + 2)
            key[: self.n - size] += have[size:] + 1
            order = np.argsort(key, kind="stable")
            if 2 * size >= depth:
                break
            key = key[order]
            rank = np.zeros(self.n, np.int32)
            rank[order[1:]] = np.cumsum(key[1:] != key[:-1], dtype=np.int32)
            size *= 2
            self.ranks[size] = rank
        self.suffixes = order.astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1].astype(np.int64)
        self.wavelet = WaveletMatrix(text[self.suffixes - 1], sigma)
        self.sigma = sigma
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def blocks(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the rows whose suffixes share their first `length` symbols, for each row."""
        if length not in self._blocks:
            new = np.zeros(self.n, bool)
            new[:1] = True
            at, rest, size = self.suffixes.astype(np.int64), length, max(self.ranks)
            while rest:
                while size > rest:
                    size //= 2
                part = np.where(at < self.n, self.ranks[size][np.minimum(at, self.n - 1)], -1)
                new[1:] |= part[1:] != part[:-1]
                at, rest = at + size, rest - size
            heads = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            self._blocks[length] = heads.astype(np.int32)[which], np.append(heads[1:], self.n).astype(np.int32)[which]
        return self._blocks[length]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of symbol + match from the interval of a match."""
        ends = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        k = len(symbol)
        return self.first[symbol] + ends[:k], self.first[symbol] + ends[k:]

    def matching_statistics(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the patterns flat[start : start + size]: the longest match that starts there, at most `depth`, and the first row of its interval.

        Symbols that the index does not have (0 or above its largest) match nothing.
        """
        length, row = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        order = np.argsort(-size, kind="stable")
        begin, size = start[order], size[order]
        low, high = np.zeros(len(size), np.int64), np.full(len(size), self.n)
        have = np.zeros(len(size), np.int64)
        for t in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -t, "left"))  # sizes above t
            at = begin[:live] + size[:live] - 1 - t
            symbol = flat[at].astype(np.int64)
            known = (symbol > 0) & (symbol < self.sigma)
            lane = np.flatnonzero(known)
            lost = np.flatnonzero(~known)
            low[lost], high[lost], have[lost] = 0, self.n, 0
            while len(lane):
                full = lane[have[lane] == self.depth]
                if len(full):
                    self._shorten(full, low, high, have)
                a, b = self.step(symbol[lane], low[lane], high[lane])
                found = a < b
                hit = lane[found]
                low[hit], high[hit] = a[found], b[found]
                have[hit] += 1
                lane = lane[~found]
                lane = lane[have[lane] > 0]
                if len(lane):
                    self._shorten(lane, low, high, have)
            length[at], row[at] = have[:live], low[:live]
        return length, row

    def _shorten(self, lane, low, high, have):
        have[lane] -= 1
        for size in np.unique(have[lane]).tolist():
            mine = lane[have[lane] == size]
            if size:
                start, end = self.blocks(size)
                low[mine], high[mine] = start[low[mine]], end[low[mine]]
            else:
                low[mine], high[mine] = 0, self.n
