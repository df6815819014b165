"""BK-trees over 64-bit fingerprints, many at once, in numpy.

Points come grouped; each group is one tree.  A tree is built level by level:
the first point of a cell is its node, and the others form the node's child
cells by their Hamming distance to it.  Searching follows, from every node met,
only the children whose distance key lies within the radius of the query's
distance to the node (triangle inequality).
"""
from __future__ import annotations

import numpy as np

#: (query, node) pairs looked at together
FRONTIER = 1 << 20


class Trees:
    """BK-trees of the groups; points of a group must be distinct."""

    def __init__(self, group: np.ndarray, points: np.ndarray):
        order = np.argsort(group, kind="stable")
        self.order, self.points = order, points[order]
        group = group[order]
        n = len(points)
        #: the node's parent and the edge's key; nodes are numbered level by level
        self.node_of = np.full(n, -1)
        cell = np.unique(group, return_inverse=True)[1] if n else np.zeros(0, np.int64)
        rest = np.arange(n)
        nodes, edges, made = [], [], 0
        while len(rest):
            first = np.ones(len(rest), bool)
            first[1:] = cell[1:] != cell[:-1]
            heads = rest[first]
            self.node_of[heads] = made + np.arange(len(heads))
            nodes.append(heads)
            mine = np.cumsum(first) - 1
            more = ~first
            below, parent = rest[more], mine[more]
            gap = np.bitwise_count(self.points[below] ^ self.points[heads[parent]]).astype(np.int64)
            key = parent * 65 + gap
            by = np.argsort(key, kind="stable")
            rest, key = below[by], key[by]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            edges.append(key[new] + made * 65)
            made += len(heads)
            cell = np.cumsum(new) - 1
        #: point of each node, and for node k > roots, edge k - roots = parent * 65 + distance, sorted
        self.point_of = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        self.roots = len(nodes[0]) if nodes else 0
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.root_of = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1 if n else np.zeros(0, np.int64)

    def links(self, radius: int):
        """Yields arrays (i, j), i's and j's of linked pairs of one group, as places in the given points; every pair once."""
        n = len(self.points)
        for a in range(0, n, FRONTIER):
            stack = [(np.arange(a, min(a + FRONTIER, n)), self.root_of[a : a + FRONTIER])]
            while stack:
                query, node = stack.pop()
                if len(query) > FRONTIER:
                    half = len(query) // 2
                    stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                    continue
                point = self.point_of[node]
                gap = np.bitwise_count(self.points[query] ^ self.points[point]).astype(np.int64)
                hit = (gap <= radius) & (query < point)
                if hit.any():
                    yield self.order[query[hit]], self.order[point[hit]]
                low = np.searchsorted(self.edges, node * 65 + np.maximum(gap - radius, 0), "left")
                high = np.searchsorted(self.edges, node * 65 + np.minimum(gap + radius, 64), "right")
                count = high - low
                total = int(count.sum())
                if total:
                    child = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total) + self.roots
                    stack.append((np.repeat(query, count), child))


def union_labels(n: int, links) -> np.ndarray:
    """Smallest member of each point's component, from batches of links (i, j)."""
    label = np.arange(n)
    for i, j in links:
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:  # shorten paths
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label
