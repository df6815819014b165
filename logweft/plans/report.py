"""Console report of a mine, in the form that template files and evaluations read.

A report is a DataFrame of its lines, in order, so that logs of any size can be
reported into a folder or streamed; the functions that return text are for logs
that a reader can take in.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import ALERT_COLOUR, BULLET_COLOUR, PALETTE, RESET, from_bytes
from ..operators.generalise import merge_components
from ..sources.templates import render, render_column, render_templates, templates_list
from .mine import MineResult

RULE = "-" * 42


def zones(tokens: Column, regions: Column, colour: bool = True) -> Column:
    """A line's text, its placeholder runs coloured in turn."""
    text = lambda g: from_bytes(F.array_join(F.slice(tokens, g["lower"] + 1, g["upper"] - g["lower"]), ""))
    if not colour:
        return from_bytes(F.array_join(tokens, ""))
    tint = lambda n: F.get(F.array(*map(F.lit, PALETTE)), n % len(PALETTE))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))
    step = lambda a, g: F.struct(F.concat(a["text"], F.when(g["is_ph"], F.concat(tint(a["n"]), text(g), F.lit(RESET))).otherwise(text(g))).alias("text"), (a["n"] + g["is_ph"].cast("int")).alias("n"))
    return F.aggregate(regions, start, step, lambda a: a["text"])


def report_lines(result: MineResult, colour: bool = True) -> DataFrame:
    """(label, part, at, line): members, contributors and exclusions of each label, line by line; to be ordered by label, part and at."""
    a = result.assembled
    tint = lambda c, x: F.concat(F.lit(c), x, F.lit(RESET)) if colour else x
    place = lambda part, at, line: ("label", F.lit(part).alias("part"), at.cast("long").alias("at"), line.alias("line"))
    named = F.col("label").cast("string")
    sizes = a.scores.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.count_if("excluded").alias("lost"))
    heads = sizes.join(a.templates.select("label", render_column(F.col("segs"), colour).alias("text")), "label")
    opening = F.array(F.concat(F.lit("Label: C"), named, F.lit(" ("), F.col("members").cast("string"), F.lit(")")), F.col("text"), F.lit(RULE))
    out = heads.select("label", F.posexplode(opening).alias("at", "line")).select(*place(0, F.col("at"), F.col("line")))
    kept = a.scores.where("NOT excluded").join(a.regions.select("row_id", zones(F.col("tokens"), F.col("regions"), colour).alias("text")), "row_id")
    confidence = F.when(F.col("n") > 2, F.concat(F.lit(":"), F.format_string("%.2f", F.abs(F.col("lof") - 1)))).otherwise("")
    out = out.unionByName(kept.select(*place(1, F.col("local"), F.concat(F.lpad(F.col("local").cast("string"), 5, " "), confidence, F.lit("|"), F.col("text")))))
    members = a.contributors.groupBy("label").agg(F.array_sort(F.collect_list("row_id")).alias("rows"))
    listed = sizes.join(members, "label", "left").select(*place(2, F.lit(0), F.concat(F.lit("Contributors C"), named, F.lit(": "), F.coalesce(F.array_join(F.transform("rows", lambda r: r.cast("string")), " "), F.lit("")))))
    out = out.unionByName(listed)
    count = tint(ALERT_COLOUR, F.concat(F.lit("    Excluded "), F.col("lost").cast("string")))
    out = out.unionByName(sizes.where("lost > 0").select(*place(3, F.lit(0), count)))
    gone = a.scores.where("excluded").join(result.lines.select("row_id", "raw"), "row_id")
    return out.unionByName(gone.select(*place(4, F.col("row_id"), tint(ALERT_COLOUR, F.concat(F.lit("    X| "), F.col("raw"))))))


def cluster_report(result: MineResult, colour: bool = True, only=None):
    """The lines of the report, one after another; only: a test of lines, made where they are, of those that are wanted."""
    lines = report_lines(result, colour)
    for r in (lines if only is None else lines.where(only(F.col("line")))).orderBy("label", "part", "at").toLocalIterator():
        yield r.line


def summary(result: MineResult, colour: bool = True) -> str:
    """The cluster summary: what parse_templates reads."""
    return render_templates(templates_list(result.assembled.templates), colour)


def component_report(result: MineResult, colour: bool = True) -> str:
    """Components of the first pass: merged templates, their members, and singletons."""
    first = result.first
    forms = {r.component: (r.base, [(s.is_ph, list(s.toks)) for s in r.segs]) for r in merge_components(first.templates, result.cover, result.template_components, result.edges).collect()}
    members: dict[int, list[int]] = {}
    indegree = {r.dst: r["count"] for r in result.edges.groupBy("dst").count().collect()}
    for r in result.template_components.orderBy("component", "label").collect():
        members.setdefault(r.component, []).append(r.label)
    segs = dict(templates_list(first.templates))
    mark = f"{BULLET_COLOUR}◈{RESET}" if colour else "◈"
    rule = "-" * 28
    out = [rule, f"Summary: {len(members)} components", rule]
    listed = []
    for c, labels in members.items():
        if len(labels) == 1:
            continue
        line = f"{mark} T{c} {render(forms[c][1], colour)}" if c in forms else f"{mark} T{c} "
        listed.append(line)
        out += [line, "-" * 29, *[f"    {k:>4}: {render(segs[k], colour)}" for k in sorted(labels, key=lambda k: (-indegree.get(k, 0), k))], ""]
    single = [labels[0] for labels in members.values() if len(labels) == 1]
    return "\n".join([*out, "Components list: ", *listed, f"Singletons: ({len(single)})", *[f"    {k:>4}: {render(segs[k], colour)}" for k in single], ""])


def report_parts(result: MineResult, colour: bool = True):
    """The whole report piece by piece: clusters, summary, and after a single pass its components."""
    for line in cluster_report(result, colour):
        yield line + "\n"
    yield summary(result, colour)
    if result.assembled is result.first:
        yield component_report(result, colour)


def report(result: MineResult, colour: bool = True) -> str:
    return "".join(report_parts(result, colour))
