"""Plain models that the operators are held against, written from their definitions."""
from __future__ import annotations

import itertools
from functools import lru_cache


def accepts(segs, toks, limit=3):
    """All ways (up to `limit`) in which segments make up tokens, each a list of captures (begin, end)."""
    out = []

    def go(k, at, caught):
        if len(out) >= limit:
            return
        if k == len(segs):
            if at == len(toks):
                out.append(caught)
            return
        is_ph, want = segs[k]
        if is_ph:
            for stop in range(at, len(toks) + 1):
                go(k + 1, stop, [*caught, (at, stop)])
        elif toks[at : at + len(want)] == want:
            go(k + 1, at + len(want), caught)

    go(0, 0, [])
    return out


def dissimilarity(a, b):
    (c, n), (d, m) = a, b
    if c in "$N" or d in "$N" or c != d:
        return 1.0
    return 0.0 if n == m else 1 - 2 * min(n, m) / (n + m)


def weighted_distance(left, right):
    """Recursive definition: like tokens are taken without alternatives."""

    @lru_cache(None)
    def go(i, j):
        if i == len(left):
            return float(len(right) - j)
        if j == len(right):
            return float(len(left) - i)
        s = dissimilarity(left[i], right[j])
        if s == 0:
            return go(i + 1, j + 1)
        return min(1 + go(i + 1, j), 1 + go(i, j + 1), s + go(i + 1, j + 1))

    return go(0, 0)


def runs(base, ref):
    """Maximal diagonal runs of equal items, by looking at every cell."""
    out = []
    for b, r in itertools.product(range(len(base)), range(len(ref))):
        if base[b] == ref[r] and not (b and r and base[b - 1] == ref[r - 1]):
            n = 0
            while b + n < len(base) and r + n < len(ref) and base[b + n] == ref[r + n]:
                n += 1
            out.append((b, r, n))
    return sorted(out)


def chains(found, n, m):
    """Cost and runs of every chain that begins and ends as it may."""
    end = lambda x: (x[0] + x[2] - 1, x[1] + x[2] - 1)

    def grow(chain, cost):
        e = end(chain[-1])
        if e == (n - 1, m - 1) or (e[0] < n - 1 and e[1] < m - 1):
            yield cost + (n - e[0]) + (m - e[1]) - 1, chain
        for x in found:
            hop = (x[0] - e[0], x[1] - e[1])
            if min(hop) >= 2:
                yield from grow([*chain, x], cost + sum(hop) - x[2])

    for x in found:
        if x[:2] == (0, 0) or min(x[:2]) > 0:
            yield from grow([x], x[0] + x[1] - x[2])


def consensus(covered, cutoff=0.9):
    """(constant places, excluded references) of {reference: places it matches}."""
    left, out = dict(covered), set()
    while True:
        n = len(left)
        votes = {}
        for places in left.values():
            for p in places:
                votes[p] = votes.get(p, 0) + 1
        limit = n if n <= 2 else int(0.9 * n) if n > int(1 / (1 - cutoff)) else n - 2
        near = {p for p, v in votes.items() if limit < v < n}
        bad = {r for r, places in left.items() if near - set(places)}
        if not bad:
            return sorted(p for p, v in votes.items() if v == n), out
        out |= bad
        left = {r: p for r, p in left.items() if r not in bad}
