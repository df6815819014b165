"""Modularity communities of one connected component: Louvain, and Leiden's refinement.

Blondel et al. (2008) and Traag et al. (2019), made deterministic: vertices are
visited in ascending order, the best gain wins, ties go to the community with
the smallest first member, and refinement merges greedily.
"""
from __future__ import annotations

Graph = dict[int, dict[int, float]]


def _moved(graph: Graph, mass: dict[int, float], label: dict[int, int], rate: float) -> bool:
    """Moves single vertices while the quality grows; says whether any moved."""
    total: dict[int, float] = {}
    for v, c in label.items():
        total[c] = total.get(c, 0.0) + mass[v]
    order = sorted(graph)
    any_move, moving = False, True
    while moving:
        moving = False
        for v in order:
            own = label[v]
            into: dict[int, float] = {own: 0.0}
            for u, w in graph[v].items():
                if u != v:
                    c = label[u]
                    into[c] = into.get(c, 0.0) + w
            total[own] -= mass[v]
            rest = rate * mass[v]
            best, here = own, into[own] - rest * total[own]
            most = here
            for c, w in into.items():
                gain = w - rest * total[c]
                if gain > most or gain == most and c < best:
                    best, most = c, gain
            if most <= here + 1e-12:
                best = own
            total[best] += mass[v]
            if best != own:
                label[v], moving, any_move = best, True, True
    return any_move


def _refined(graph: Graph, mass: dict[int, float], label: dict[int, int], rate: float) -> dict[int, int]:
    """Splits communities into well-connected parts: singletons merge inside their community only, each at most once."""
    part = {v: v for v in graph}
    total, size = dict(mass), {v: 1 for v in graph}
    for v in sorted(graph):
        if part[v] != v or size[v] > 1:
            continue
        into: dict[int, float] = {}
        for u, w in graph[v].items():
            if u != v and label[u] == label[v]:
                into[part[u]] = into.get(part[u], 0.0) + w
        into.pop(v, None)
        good = [(rate * mass[v] * total[c] - w, c) for c, w in into.items() if w - rate * mass[v] * total[c] > 0]
        if good:
            c = min(good)[1]
            part[v] = c
            total[c] += mass[v]
            size[c] += 1
            size[v] = 0
    return part


def _collapsed(graph: Graph, part: dict[int, int]) -> Graph:
    out: Graph = {c: {} for c in part.values()}
    for v, row in graph.items():
        for u, w in row.items():
            out[part[v]][part[u]] = out[part[v]].get(part[u], 0.0) + w
    return out


def optimise(edges: list[tuple[int, int, float]], total: float, resolution: float = 1.0, refine: bool = True, density: float | None = None) -> dict[int, int]:
    """Community of each vertex of undirected edges; total is the weight of the whole graph's edges.

    The quality is modularity; with a density, the expected weight of any pair
    of vertices, it is that of a random graph of equal pairs (Erdos and Renyi):
    weights inside communities less resolution * density a pair.
    """
    graph: Graph = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            row = graph.setdefault(int(x), {})
            row[int(y)] = row.get(int(y), 0.0) + float(w)
    home = {v: v for v in graph}
    label = {v: v for v in graph}
    mass = {v: sum(row.values()) for v, row in graph.items()} if density is None else dict.fromkeys(graph, 1.0)
    rate = resolution / (2 * total) if density is None else resolution * density
    while True:
        moved = _moved(graph, mass, label, rate)
        if not moved or len(set(label.values())) == len(graph):
            return {v: label[home[v]] for v in home}
        part = _refined(graph, mass, label, rate) if refine else dict(label)
        if len(set(part.values())) == len(graph):
            part = dict(label)
        # parts become vertices named by a member; each starts in its community
        first: dict[int, int] = {}
        for p, c in sorted((p, label[v]) for v, p in part.items()):
            first.setdefault(c, p)
        home = {v: part[h] for v, h in home.items()}
        joint = dict.fromkeys(part.values(), 0.0)
        for v, p in part.items():
            joint[p] += mass[v]
        label, graph, mass = {p: first[label[v]] for v, p in part.items()}, _collapsed(graph, part), joint


def modularity(edges: list[tuple[int, int, float]], label: dict[int, int], resolution: float = 1.0) -> float:
    total = sum(w for *_, w in edges)
    inside, degree = 0.0, {}
    for a, b, w in edges:
        inside += w * (label[a] == label[b])
        for v in (a, b):
            degree[label[v]] = degree.get(label[v], 0.0) + w
    return inside / total - resolution * sum(d * d for d in degree.values()) / (4 * total * total)
