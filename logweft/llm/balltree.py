"""Ball trees for exact maximum inner product search.

A tree splits its points along the line between two far-apart ones until leaves
are small; a node's ball (centre, radius) bounds the inner product with a query
q of everything below it by q.centre + |q| * radius (Ram and Gray, 2012).  All
queries of a block descend together: a node goes on with those queries whose
bound reaches their current k-th score, the child with the larger bound first,
and the scores found in one tree prune the next.

Vectors are integers held as float64.  Inner products are exact: through floats
or 64-bit integers where these hold every sum, else through Python's integers;
a score beyond the range of 64 bits counts as the range's end.
"""
from __future__ import annotations

import numpy as np

LEAF = 256
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def small(vectors: np.ndarray) -> np.ndarray:
    """Rows all of whose products with each other fit 64 bits."""
    limit = np.sqrt(2.0**61 / max(1, vectors.shape[1]))
    return (np.abs(vectors) <= limit).all(1)


class BallTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        #: node: (centre, radius, points, left, right)
        self.nodes: list[tuple] = []
        if len(ids):
            self._build(np.arange(len(ids)))

    def _build(self, at: np.ndarray) -> int:
        x = self.vectors[at]
        centre = x.mean(0)
        gap = ((x - centre) ** 2).sum(1)
        radius = float(np.sqrt(gap.max()))
        me = len(self.nodes)
        self.nodes.append((centre, radius, at, -1, -1))
        if len(at) > LEAF and radius > 0:
            a = x[gap.argmax()]
            b = x[((x - a) ** 2).sum(1).argmax()]
            side = x @ (b - a)
            order = np.argsort(side, kind="stable")  # halves, so equal points cannot unbalance the tree
            half = len(at) // 2
            self.nodes[me] = (centre, radius, None, self._build(at[order[:half]]), self._build(at[order[half:]]))
        return me


class TopK:
    """The best k (score, id) of each query so far; ties go to the smaller id.

    What reaches a query's k-th score is held in flat arrays and cut back to
    the best k whenever they have grown by as much again.
    """

    def __init__(self, query_ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.query_ids, self.k = query_ids, k
        #: a score that k candidates are known to reach
        self.kth = np.full(len(query_ids), LOW) if floor is None else floor.copy()
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.fresh: list[tuple] = []
        self.held = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray):
        """scores (len(rows) x len(ids)); a query's own row is no candidate, equal scores may have smaller ids."""
        r, c = np.nonzero(scores >= self.kth[rows][:, None])
        own = ids[c] == self.query_ids[rows[r]]
        if own.any():
            r, c = r[~own], c[~own]
        if len(r):
            self.fresh.append((rows[r], scores[r, c], ids[c]))
            self.held += len(r)
            if self.held > max(1 << 15, 2 * self.k * len(self.query_ids)):
                self.cut()

    def cut(self):
        """Only the best k of each query stay."""
        if not self.fresh:
            return
        row, score, ids = (np.concatenate([old, *new]) for old, new in zip((self.row, self.score, self.id), zip(*self.fresh)))
        order = np.lexsort((ids, ~score, row))  # ~x descends where x ascends, without overflow
        row, score, ids = row[order], score[order], ids[order]
        first = np.searchsorted(row, row)
        place = np.arange(len(row)) - first
        stay = place < self.k
        full = place == self.k - 1
        self.kth[row[full]] = np.maximum(self.kth[row[full]], score[full])
        self.row, self.score, self.id = row[stay], score[stay], ids[stay]
        self.fresh, self.held = [], 0


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products as int64, ends of the range beyond it."""
    if object in (queries.dtype, vectors.dtype):
        return _wide(queries, vectors)
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if most < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    if most < 2.0**62:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    return _wide(queries, vectors)


def _wide(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    a, b = ([[int(x) for x in row] for row in m.tolist()] for m in (queries, vectors))
    return np.array([[min(max(sum(x * y for x, y in zip(q, v)), LOW), HIGH) for v in b] for q in a], np.int64).reshape(len(a), len(b))


def search(tree: BallTree, queries: np.ndarray, top: TopK, rows: np.ndarray | None = None) -> int:
    """Adds the tree's points to top for the queries `rows` of it (all by default), whose vectors are given; returns the number of points scored, over all queries."""
    rows = np.arange(len(queries)) if rows is None else rows
    if not tree.nodes or not len(rows):
        return 0
    scored = 0
    norm = np.sqrt((queries**2).sum(1))

    def bound(node: int, at: np.ndarray) -> np.ndarray:
        centre, radius = tree.nodes[node][:2]
        b = queries[at] @ centre + norm[at] * radius
        return b + 1e-9 * (1 + np.abs(b) + norm[at] * (np.sqrt(centre @ centre) + radius))

    everyone = np.arange(len(rows))
    stack = [(0, everyone, bound(0, everyone))]
    while stack:
        node, at, limit = stack.pop()
        at = at[limit >= top.kth[rows[at]]]  # equal scores may have smaller ids
        if not len(at):
            continue
        _, _, points, left, right = tree.nodes[node]
        if points is not None:
            scored += len(at) * len(points)
            top.add(rows[at], tree.ids[points], products(queries[at], tree.vectors[points]))
            continue
        a, b = bound(left, at), bound(right, at)
        first = a >= b
        # what each query should see first is pushed last
        stack += [(right, at[first], b[first]), (left, at[~first], a[~first]), (left, at[first], a[first]), (right, at[~first], b[~first])]
    return scored
