"""Which templates generalise which, and the components that follow.

The walk over a pair of templates depends on nothing but the two, so all pairs
run in parallel.  Templates are the output of a mine: thousands, not the lines.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import spread
from .graph import communities

START = -1
CONSTANT, PLACEHOLDER, EPSILON = "constant", "placeholder", "epsilon"


def chain_of(segs: list) -> tuple[list[str], list[str]]:
    """(vertex texts, kinds of the edges into them and, last, into the end) of a template's linear automaton."""
    texts, kinds, hole = [], [], False
    for is_ph, toks in segs:
        if is_ph:
            hole = True
            continue
        for t in toks:
            texts.append(t)
            kinds.append(PLACEHOLDER if hole else CONSTANT)
            hole = False
    return texts, [*kinds, PLACEHOLDER if hole else EPSILON]


class _Walk:
    """A walk of a reference's items along a base's chain, from a vertex and an item on.

    Vertices of the base are numbered from 0; START is before them and their
    number is the end.  Afterwards `last` is the last vertex met and `seen` the
    last item matched; `hops` and `items` count what was walked over.
    """

    def __init__(self, texts: list[str], kinds: list[str], items: list[str | None], last: int = START, place: int = 0):
        self.texts, self.kinds, self.items, self.end = texts, kinds, items, len(texts)
        self.at, self.place, self.last, self.seen = last + 1, place, last, place - 1
        self.trace: list[tuple[int, int, str, list[str]]] = []
        self.hops = self.walked = 0
        self.run()

    def advance(self) -> bool:
        spanned = self.items[self.seen + 1 : self.place]
        hole = None in spanned or (self.place < len(self.items) and self.items[self.place] is None)
        kind = PLACEHOLDER if hole else EPSILON if self.at == self.end and self.kinds[self.end] == EPSILON else CONSTANT
        self.trace.append((self.last, self.at, kind, [t for t in spanned if t is not None]))
        self.hops += self.at - self.last
        self.walked += min(self.place + 1, len(self.items)) - self.seen - 1
        self.last, self.seen = self.at, self.place
        stepped = self.at < self.end
        self.at, self.place = self.at + stepped, min(self.place + 1, len(self.items))
        return stepped

    def meet(self, hole: bool) -> bool:
        """Moves to where base and reference meet again behind a placeholder."""
        items, texts, size = self.items, self.texts, len(self.items)
        if self.place < size:
            ahead = next((k for k in range(self.place, size) if self.at < self.end and items[k] == texts[self.at]), None)
            if ahead is not None:
                self.place = ahead
                return True
            if items[self.place] is not None:
                along = next((k for k in range(self.at, self.end) if texts[k] == items[self.place]), None)
                if along is not None:
                    self.at = along
                    return True
        after = min(self.at + 1, self.end)
        if hole and self.place == size and after == self.end:
            self.at = after
            return True
        return self.kinds[self.at] == PLACEHOLDER and self.at == self.end and self.place == size

    def run(self):
        size = len(self.items)
        if self.at > self.end:
            return
        while self.place < size:
            item = self.items[self.place]
            if item is not None and self.kinds[self.at] == CONSTANT:
                if item != self.texts[self.at] or not self.advance():
                    break
                continue
            if self.kinds[self.at] == EPSILON:
                break
            hole = item is None
            self.place += hole
            if not self.meet(hole) or not self.advance():
                break
        if self.place == size and self.at == self.end:
            self.advance()


def _items(ref: list) -> list[str | None]:
    return [t for p, toks in ref for t in ([None] if p else toks)]


def _captured(trace: list) -> int:
    return sum(len(c) for _, _, kind, c in trace if kind == PLACEHOLDER)


def walk(base: list, ref: list) -> tuple[bool, int, list[tuple[int, int, str, list[str]]]]:
    """How far `ref` runs along `base`: (reaches the end, tokens captured on placeholder edges, trace of (from, to, kind, captured))."""
    found = _Walk(*chain_of(base), _items(ref))
    return found.last == found.end, _captured(found.trace), found.trace


def piecewise_walk(base: list, ref: list, choose=min) -> tuple[bool, int, list[tuple[int, int, str, list[str]]]]:
    """As walk, but where it stops it goes on behind a gap: one item further, one vertex further, or both.

    A piece's gain is the smaller of the vertices and the items that it and
    what follows it walk over.  Of the three ways on `choose` takes one by
    gain: min (the rule of record, by which all three have to gain something)
    or max.
    """
    texts, kinds = chain_of(base)
    items = _items(ref)
    end, size = len(texts), len(items)
    known: dict[tuple[int, int], tuple] = {}

    def pieces(last: int, place: int) -> tuple:
        """(last vertex, hops, items, trace) from a vertex and an item on."""
        stack = [(last, place)]
        while stack:
            here = stack[-1]
            if here in known:
                stack.pop()
                continue
            w = _Walk(texts, kinds, items, *here)
            at = w.seen if w.seen >= here[1] else here[1]
            if w.last == end or at >= size:
                known[here] = w.last, w.hops, w.walked, w.trace
                continue
            ways = [(w.last, at + 1) if at + 1 < size else None, (w.last + 1, at) if w.last + 1 < end else None, (w.last + 1, at + 1) if at + 1 < size and w.last + 1 < end else None]
            if missing := [x for x in ways if x and x not in known]:
                stack += missing
                continue
            gains = [min(known[x][1:3]) if x else 0 for x in ways]
            best = choose(gains)
            more = known[ways[gains.index(best)]] if best else (w.last, 0, 0, [])
            known[here] = more[0], w.hops + more[1], w.walked + more[2], w.trace + more[3]
        return known[last, place]

    last, _, _, trace = pieces(START, 0)
    return last == end, _captured(trace), trace


def subset_walk(base: list, ref: list) -> list[tuple[int, int, int]]:
    """Pieces (from vertex, to vertex, gain) by which parts of ref lie along base: from each vertex on the item from which the walk is longest, the first of equals."""
    texts, kinds = chain_of(base)
    items = _items(ref)
    last, place, out = START, 0, []
    while last < len(texts):
        best = None
        for p in range(place, len(items)):
            w = _Walk(texts, kinds, items, last, p)
            gain = w.hops + w.walked
            if gain and (best is None or gain > best[0]):
                best = gain, w
        if best is None:
            last += 1
            continue
        out.append((last, best[1].last, best[0]))
        last, place = best[1].last + 1, best[1].seen + 1
    return out


def _list(segs) -> list:
    return [(s["is_ph"], list(s["toks"])) for s in segs]


_COVER = "covered boolean, capture int, trace array<struct<src:int,dst:int,kind:string,captured:array<string>>>"


def _cover_by(step):
    def cover(base: pd.Series, ref: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(base, ref):
            covered, capture, trace = step(_list(a), _list(b))
            out.append((covered, capture, [{"src": s, "dst": d, "kind": k, "captured": c} for s, d, k, c in trace]))
        return pd.DataFrame(out, columns=["covered", "capture", "trace"])

    return F.pandas_udf(cover, _COVER)


def coverage(templates: DataFrame, piecewise: bool = False) -> DataFrame:
    """(i, j, covered, capture, trace) for ordered pairs of different templates: whether j runs along i to its end, over gaps too if piecewise."""
    t = templates.select(F.col("label").alias("i"), F.col("segs").alias("a"))
    u = templates.select(F.col("label").alias("j"), F.col("segs").alias("b"))
    found = spread(t.join(u, F.col("i") != F.col("j"))).select("i", "j", _cover_by(piecewise_walk if piecewise else walk)("a", "b").alias("c"))
    return found.select("i", "j", "c.covered", "c.capture", "c.trace")


def generalisation_graph(cover: DataFrame) -> DataFrame:
    """(src, dst, weight): an edge from each template's first covering template to it."""
    best = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("covered"), "j"))
    return cover.withColumn("r", best).where("r = 1 AND covered").select(F.col("j").alias("src"), F.col("i").alias("dst"), F.lit(1.0).alias("weight"))


def refine(templates: DataFrame, cover: DataFrame, algorithm: str = "components") -> DataFrame:
    """(label, component) of each template."""
    vertices = templates.select(F.col("label").alias("id"))
    return communities(vertices, generalisation_graph(cover), algorithm).select(F.col("id").alias("label"), F.col("label").alias("component"))


def component_bases(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, base, size): of each component the template with most edges into it, ties to the smaller label."""
    indegree = edges.groupBy(F.col("dst").alias("label")).agg(F.count(F.lit(1)).alias("indeg"))
    order = Window.partitionBy("component").orderBy(F.desc("indeg"), "label")
    x = components.join(indegree, "label", "left").fillna(0, ["indeg"])
    return x.withColumn("r", F.row_number().over(order)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("component"))).where("r = 1").select("component", F.col("label").alias("base"), "size")


def merged(base: list, traces: dict[int, list]) -> list:
    """The display form of a component: its base's chain, walked along the edges that the members left on it.

    traces: by member, lists of (from, to, kind, captured).  At each vertex the
    commonest length of the members' edges wins, ties to the longest; without
    edges the walk ends.
    """
    texts, kinds = chain_of(base)
    out, at = [], START
    while at < len(texts):
        pool = [e for t in traces.values() for e in t if e[0] == at and e[1] > at]
        if not pool:
            break
        hops: dict[int, int] = {}
        for e in pool:
            hops[e[1] - at] = hops.get(e[1] - at, 0) + 1
        hop = max(hops, key=lambda h: (hops[h], h))
        skip = False
        if hop > 1 or kinds[at + 1] == PLACEHOLDER:
            out.append((True, []))
        elif any(e[2] == PLACEHOLDER for e in pool):
            out.append((True, []))
            skip = True
        at += hop
        if not skip and at < len(texts):
            out.append((False, [texts[at]]))
    joined: list = []
    for is_ph, toks in out:
        if joined and joined[-1][0] == is_ph:
            if not is_ph:
                joined[-1][1].extend(toks)
            continue
        joined.append((is_ph, list(toks)))
    return joined


def merge_components(templates: DataFrame, cover: DataFrame, components: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, base, segs): merged templates of components of two or more."""
    bases = component_bases(components, edges).where("size > 1")
    traces = cover.join(bases, F.col("i") == F.col("base")).join(components.select(F.col("label").alias("j"), F.col("component").alias("cj")), "j").where("component = cj")
    per = traces.groupBy("component", "base").agg(F.sort_array(F.collect_list(F.struct("j", "trace"))).alias("traces")).join(templates.select(F.col("label").alias("base"), "segs"), "base")

    @F.pandas_udf("array<struct<is_ph:boolean,toks:array<string>>>")
    def form(segs: pd.Series, traces: pd.Series) -> pd.Series:
        plain = lambda t: [(e["src"], e["dst"], e["kind"], list(e["captured"])) for e in t]
        return pd.Series([[{"is_ph": p, "toks": t} for p, t in merged(_list(s), {x["j"]: plain(x["trace"]) for x in tr})] for s, tr in zip(segs, traces)])

    return per.select("component", "base", form("segs", "traces").alias("segs"))


def automaton(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices (label, v, text), edges (label, src, dst, kind)) of the templates' chains."""

    @F.pandas_udf("struct<texts:array<string>,kinds:array<string>>")
    def chain(segs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([chain_of(_list(s)) for s in segs], columns=["texts", "kinds"])

    c = templates.select("label", chain("segs").alias("c"))
    vertices = c.select("label", F.posexplode("c.texts").alias("v", "text"))
    edges = c.select("label", F.posexplode("c.kinds").alias("dst", "kind")).select("label", (F.col("dst") - 1).alias("src"), "dst", "kind")
    return vertices, edges


def pattern_graph(templates: DataFrame, cover: DataFrame) -> DataFrame:
    """(template, src, dst, id, kind): all templates' chains, and on them the edges that the walks of the others left; vertices are numbers on their template's chain."""
    own = automaton(templates)[1].select(F.col("label").alias("template"), "src", "dst", F.col("label").alias("id"), "kind")
    left = cover.select(F.col("i").alias("template"), F.explode("trace").alias("e"), F.col("j").alias("id")).select("template", "e.src", "e.dst", "id", "e.kind")
    return own.union(left)


def subgraph(graph: DataFrame, templates: DataFrame) -> DataFrame:
    """The part of a pattern graph among some templates (label): their chains, and the edges that they left on each other."""
    some = templates.select("label").distinct()
    return graph.join(some.select(F.col("label").alias("template")), "template", "left_semi").join(some.select(F.col("label").alias("id")), "id", "left_semi").select("template", "src", "dst", "id", "kind")


def cleaned(graph: DataFrame, templates: DataFrame) -> DataFrame:
    """A pattern graph in which the given templates' (label) chains have their own edges alone."""
    some = templates.select(F.col("label").alias("template")).distinct().withColumn("bare", F.lit(True))
    return graph.join(some, "template", "left").where("bare IS NULL OR id = template").drop("bare")


def row_components(labels: DataFrame, components: DataFrame) -> DataFrame:
    """(row_id, label, component): every member of a label, outliers and accidentals too, has its component."""
    return labels.join(components, "label").select("row_id", "label", "component")
