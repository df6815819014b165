"""Graphs and labels in other programs' formats, for graphs that fit a file."""
from __future__ import annotations

import re
import struct
import sys
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: the smallest weight written, as readers drop zero weights
TINY = sys.float_info.epsilon


def graphml_lines(vertices: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """(part, a, b, line): a graph's text line by line, to be ordered by part, a and b.

    vertices (id, label), edges (src, dst and attributes); a weight of 0 is
    written as the smallest double step.  Graphs of any size are written as
    text with it; the other functions here make one string.
    """
    text = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    name = lambda c: F.concat(F.lit('"n'), F.replace(text(F.col(c)), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    attributes = [c for c in edges.columns if c not in ("src", "dst")]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '  <key id="label" for="node" attr.name="label" attr.type="string"/>']
    head += [f'  <key id="e_{c}" for="edge" attr.name="{c}" attr.type="{"double" if c == "weight" else "string"}"/>' for c in attributes]
    head.append(f'  <graph id="G" edgedefault="{"directed" if directed else "undirected"}">')
    value = lambda c: F.when(F.col(c) == 0, F.lit(TINY)).otherwise(F.col(c)) if c == "weight" else F.col(c)
    data = [F.concat(F.lit(f'<data key="e_{c}">'), text(value(c)), F.lit("</data>")) for c in attributes]
    node = F.concat(F.lit("    <node id="), name("id"), F.lit('><data key="label">'), text(F.col("label")), F.lit("</data></node>"))
    edge = F.concat(F.lit("    <edge source="), name("src"), F.lit(" target="), name("dst"), F.lit(">"), *data, F.lit("</edge>"))
    around = [(0, f"{k:03}", "", x) for k, x in enumerate(head)] + [(3, "0", "", "  </graph>"), (3, "1", "", "</graphml>")]
    # an Arrow table becomes a part of the plan, so that whoever asks for other parts runs no task for it
    columns = [pa.array(c, t) for c, t in zip(zip(*around), (pa.int32(), pa.string(), pa.string(), pa.string()))]
    frame = vertices.sparkSession.createDataFrame(pa.table(columns, ["part", "a", "b", "line"]))
    nodes = vertices.select(F.lit(1).alias("part"), F.col("id").cast("string").alias("a"), F.lit("").alias("b"), node.alias("line"))
    links = edges.select(F.lit(2).alias("part"), F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"), edge.alias("line"))
    return frame.union(nodes).union(links)


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str, directed: bool = False) -> None:
    """A graph as one file, streamed line by line."""
    with open(path, "w", encoding="utf-8") as f:
        for r in graphml_lines(vertices, edges, directed).orderBy("part", F.length("a"), "a", F.length("b"), "b").toLocalIterator():
            f.write(r.line + "\n")


def weighted_graphml(vertices: DataFrame, edges: DataFrame, directed: bool = False) -> str:
    """A similarity or template graph: vertices (id), edges (src, dst, weight)."""
    rows = graphml_lines(vertices.select("id", F.col("id").cast("string").alias("label")), edges.select("src", "dst", "weight"), directed).orderBy("part", F.length("a"), "a", F.length("b"), "b").collect()
    return "\n".join([*(r.line for r in rows), ""])


def chain_graphml(graph: DataFrame, path: str) -> None:
    """The chain graph of one pair of sequences (src, dst, weight) as a file."""
    edges = graph.select("src", "dst", "weight")
    names = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    write_graphml(names.select("id", F.col("id").alias("label")), edges, path, True)


def cooccurrence_graphml(pairs: DataFrame, path: str) -> None:
    """How often matched segments follow one another (text, next_text, n) as a file, segments named by their text."""
    edges = pairs.select(F.col("text").alias("src"), F.col("next_text").alias("dst"), F.col("n").cast("double").alias("weight"))
    names = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    write_graphml(names.select("id", F.col("id").alias("label")), edges, path, True)


def graphml(vertices: list[tuple[int, str]], edges: list[tuple[int, int, dict[str, str]]], directed: bool = False) -> str:
    """vertices (id, label), edges (from, to, attributes)."""
    keys = sorted({k for *_, a in edges for k in a})
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '  <key id="label" for="node" attr.name="label" attr.type="string"/>']
    out += [f'  <key id="e_{k}" for="edge" attr.name="{k}" attr.type="{"double" if k == "weight" else "string"}"/>' for k in keys]
    out.append(f'  <graph id="G" edgedefault="{"directed" if directed else "undirected"}">')
    out += [f'    <node id="n{v}"><data key="label">{escape(t)}</data></node>' for v, t in vertices]
    for n, (a, b, attributes) in enumerate(edges):
        data = "".join(f'<data key="e_{k}">{escape(str(attributes[k]))}</data>' for k in keys if k in attributes)
        out.append(f'    <edge id="e{n}" source="n{a}" target="n{b}">{data}</edge>')
    return "\n".join([*out, "  </graph>", "</graphml>", ""])


def nearest_graphml(dist: DataFrame, k: int = 5) -> str:
    """The k smallest distances of each row, itself included, as a directed graph."""
    rows = dist.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("r") <= k).orderBy("i", "d", "j").collect()
    return graphml([(i, str(i)) for i in sorted({r.i for r in rows})], [(r.i, r.j, {"weight": repr(r.d or TINY)}) for r in rows], True)


def _chains(templates: list[tuple[int, list]]):
    """Vertices and edges of the templates' automata, numbered through."""
    from ..functions.tokens import shown
    from ..operators.generalise import chain_of

    vertices, edges = [], []
    for label, segs in templates:
        texts, kinds = chain_of(segs)
        first = len(vertices)
        names = [f"S{label}", *[shown([t]) for t in texts], f"T{label}"]
        vertices += [(first + k, t, label) for k, t in enumerate(names)]
        edges += [(first + k, first + k + 1, kind, label, names[k + 1]) for k, kind in enumerate(kinds)]
    return vertices, edges


def automata_graphml(templates: list[tuple[int, list]]) -> str:
    vertices, edges = _chains(templates)
    names = {"placeholder": "$", "epsilon": "ε"}
    return graphml([(v, str(label)) for v, _, label in vertices], [(a, b, {"label": names.get(kind, text), "type": str(label)}) for a, b, kind, label, text in edges], True)


def colour(n: int, total: int = 43) -> str:
    """One of `total` hues by number."""
    return f"{n % total / total:.3f} 0.650 0.850"


def automata_dot(templates: list[tuple[int, list]], only: set[int] | None = None) -> str:
    """Automata as Graphviz text: placeholders dashed, epsilons dotted, blanks visible; only: the templates of a component."""
    vertices, edges = _chains([t for t in templates if only is None or t[0] in only])
    quote = lambda t: '"' + t.replace("\\", "\\\\").replace('"', '\\"').replace(" ", "□") + '"'
    style = {"placeholder": "dashed", "epsilon": "dotted", "constant": "solid"}
    out = ["digraph G {", "  rankdir=LR;"]
    out += [f'  {v} [label={quote(t)}, color="{colour(label)}"];' for v, t, label in vertices]
    out += [f'  {a} -> {b} [label="{label}", style={style[kind]}, color="{colour(label)}"];' for a, b, kind, label, _ in edges]
    return "\n".join([*out, "}", ""])


def read_integer_row(data: bytes) -> list[int]:
    """Numbers of a binary row of matrix software: a header `ARMA_MAT_BIN_I[US]00[48]`, dimensions `1 N`, native integers.

    Negative numbers and the all-ones mark of unassigned labels are errors.
    """
    parts = data.split(b"\n", 2)
    if len(parts) != 3 or not (m := re.fullmatch(rb"ARMA_MAT_BIN_I([US])00([48])\s*", parts[0])):
        raise ValueError("not a binary integer row")
    width, kind = int(m[2]), {(b"U", 4): "I", (b"U", 8): "Q", (b"S", 4): "i", (b"S", 8): "q"}[m[1], int(m[2])]
    size = parts[1].split()
    if len(size) != 2 or size[0] != b"1" or not size[1].isdigit() or len(parts[2]) != int(size[1]) * width:
        raise ValueError("dimensions and payload differ")
    values = list(struct.unpack(f"={int(size[1])}{kind}", parts[2]))
    if any(x < 0 or (m[1] == b"U" and x == (1 << 8 * width) - 1) for x in values):
        raise ValueError("a row has no label")
    return values


def write_integer_row(values: list[int]) -> bytes:
    return b"ARMA_MAT_BIN_IU008\n1 %d\n" % len(values) + struct.pack(f"={len(values)}Q", *values)


def label_rows(spark, path: str) -> DataFrame:
    """(row_id, label) from a binary row file anywhere that Spark reads."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    return spark.createDataFrame(list(enumerate(read_integer_row(data))), "row_id long, label long")
