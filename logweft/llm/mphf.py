"""Minimal perfect hash of 64-bit keys, with fingerprint and value arrays.

Levels of bit arrays: at each level the keys not placed yet hash to twice as
many positions; those alone on theirs set the bit, the others go on.  A key's
index is the number of set bits before its own.  About three bits a key.
"""
from __future__ import annotations

import numpy as np

from .words import mix

GAMMA = 2.0
LEVELS = 40


def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Maps n distinct uint64 keys onto 0..n-1; other keys get -1 or any index."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest, base = np.asarray(keys, np.uint64), 0
        while len(rest) and len(self.levels) < LEVELS:
            size = max(64, int(GAMMA * len(rest)) + 63 & ~63)
            spot = _spot(rest, len(self.levels), size)
            alone = np.bincount(spot, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, base + np.concatenate([[0], np.cumsum(ones)[:-1]])))
            base += int(ones.sum())
            rest = rest[~alone[spot]]
        #: keys left after all levels, practically none
        self.rest, self.base = np.sort(rest), base
        self.n = base + len(rest)

    def index(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (size, words, rank) in enumerate(self.levels):
            if not len(todo):
                return out
            spot = _spot(keys[todo], level, size)
            word, bit = spot >> 6, (spot & 63).astype(np.uint64)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            w, b = word[hit], bit[hit]
            below = words[w] & ((np.uint64(1) << b) - np.uint64(1))
            out[todo[hit]] = rank[w] + np.bitwise_count(below)
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[at] == keys[todo]
            out[todo[hit]] = self.base + at[hit]
        return out


class LineIndex:
    """Perfect hash over the first half of 128-bit line hashes, with the other half as fingerprint, a count and the last holder for each."""

    def __init__(self, key: np.ndarray, check: np.ndarray, count: np.ndarray, last: np.ndarray):
        self.hash = PerfectHash(key)
        at = self.hash.index(key)
        self.fingerprint, self.count, self.last = np.zeros(len(key), np.uint64), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        self.fingerprint[at], self.count[at], self.last[at] = check, count, last

    def probe(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the line is in the index, its last holder)."""
        if not self.hash.n:
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = self.hash.index(key)
        found = (at >= 0) & (self.fingerprint[at] == check)
        return found, self.last[at]
