"""Matching lines against templates.

A template accepts a line if its constants equal whole tokens and placeholders
take any number of tokens, from the line's first token to its last.  Constants
between placeholders are blocks.  A line's tokens are joined by a separator, so
whole tokens are pieces between separators.

Templates are few, so up to LITERAL of them are made part of the plan: each is
a regular expression, compiled once, behind comparisons of the line's two ends.
A match that takes each block's first place and, if it has several
placeholders, one over the reversed line that takes each block's last, are the
extremes of all ways; the line is accepted in one way only if they agree, and
then placeholders have captures.  Lines are neither joined nor moved.  The
expressions never go back over a choice: blocks are searched for one after
another, and the last one stands at the end.

More templates than that are joined with the lines: those that begin with a
constant are met only by lines with that first token, the others by every line.
Blocks' first feasible places from the left and from the right then come from
string searches.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import from_bytes, tokens
from ..sources.templates import render_column

CAPTURES = "array<struct<placeholder:int,token_begin:int,token_end:int,value:string>>"
MATCH = f"array<struct<template:string,capture_ambiguous:boolean,captures:{CAPTURES}>>"


#: between tokens, and between captures; no byte's characters
SEP, GROUP = "\ue000", "\ue001"
#: templates that become part of a plan at most
LITERAL = 256


def let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def joined(toks: Column) -> Column:
    """Tokens in one string, each between separators; a separator alone for none."""
    return F.concat(F.lit(SEP), F.array_join(F.transform(toks, lambda t: F.concat(t, F.lit(SEP))), ""))


_ITEM = "array<struct<gap:int,toks:array<string>>>"


def blocks(segs: Column) -> Column:
    """struct<items array<struct<gap, text>>, tail>: blocks of constants with the number of placeholders before each, and at the end."""

    def add(a, s):
        items, gap, size = a["items"], a["gap"], F.size(a["items"])
        last = F.try_element_at(items, F.lit(-1))
        fresh = F.concat(items, F.array(F.struct(gap.alias("gap"), s["toks"].alias("toks"))))
        longer = F.concat(F.slice(items, 1, F.greatest(size - 1, F.lit(0))), F.array(F.struct(last["gap"].alias("gap"), F.concat(last["toks"], s["toks"]).alias("toks"))))
        more = F.when((gap == 0) & (size > 0), longer).otherwise(fresh)
        return (
            F.when(s["is_ph"], F.struct(items.alias("items"), (gap + 1).alias("gap")))
            .when(F.size(s["toks"]) == 0, F.struct(items.alias("items"), gap.alias("gap")))
            .otherwise(F.struct(more.cast(_ITEM).alias("items"), F.lit(0).alias("gap")))
            .cast(f"struct<items:{_ITEM},gap:int>")
        )

    start = F.struct(F.array().cast(_ITEM).alias("items"), F.lit(0).alias("gap")).cast(f"struct<items:{_ITEM},gap:int>")
    return F.aggregate(segs, start, add, lambda a: F.struct(F.transform(a["items"], lambda x: F.struct(x["gap"].alias("gap"), joined(x["toks"]).alias("text"))).alias("items"), a["gap"].alias("tail")))


def turned(b: Column) -> Column:
    """Blocks read from the end."""
    items = b["items"]
    gap = lambda k: F.coalesce(F.get(items, F.size(items) - k)["gap"], b["tail"])
    back = F.transform(F.reverse(items), lambda x, k: F.struct(F.when(k == 0, b["tail"]).otherwise(gap(k)).alias("gap"), F.reverse(x["text"]).alias("text")))
    return F.struct(back.alias("items"), F.coalesce(F.get(items, F.lit(0))["gap"], F.lit(0)).alias("tail"))


def places(s: Column, b: Column) -> Column:
    """First feasible place of each block in a joined line, from the left; -1 from the first block that has none.

    A block behind a placeholder stands where it is found first, one without
    where the last ended, and the last one without a placeholder after it at
    the end.
    """
    items, tail = b["items"], b["tail"]

    def add(a, x):
        k = F.size(a["out"])
        size = F.length(x["text"])
        fixed = F.when((k == F.size(items) - 1) & (tail == 0), F.length(s) - size + 1).when(x["gap"] == 0, a["at"])
        stands = (fixed >= a["at"]) & ((x["gap"] > 0) | (fixed == a["at"])) & (F.substring(s, fixed, size) == x["text"])
        spot = F.when(a["at"] < 1, -1).when(fixed.isNotNull(), F.when(stands, fixed).otherwise(-1)).otherwise(F.nullif(F.call_function("locate", x["text"], s, a["at"]), F.lit(0)))
        return let(F.coalesce(spot, F.lit(-1)), lambda p: F.struct(F.concat(a["out"], F.array(p)).alias("out"), F.when(p > 0, p + size - 1).otherwise(-1).alias("at")))

    return F.aggregate(items, F.struct(F.array().cast("array<int>").alias("out"), F.lit(1).alias("at")), add, lambda a: a["out"])


def fit(s: Column, b: Column, back: Column) -> Column:
    """struct<ok, ambiguous, left> of a joined line and a template's blocks.

    A line fits if every block has a place; it fits in one way if the places
    from the left are those from the right and neighbouring placeholders take
    nothing.
    """
    n = F.size(b["items"])

    def settle(left):
        ok = F.when(n == 0, (b["tail"] > 0) | (F.length(s) == 1)).otherwise(F.get(left, n - 1) > 0)
        right = F.reverse(F.zip_with(places(F.reverse(s), back), back["items"], lambda p, x: F.length(s) - p - F.length(x["text"]) + 2))
        ends = F.transform(b["items"], lambda x, k: F.when(k == 0, 1).otherwise(F.get(left, k - 1) + F.length(F.get(b["items"], k - 1)["text"]) - 1))
        wide = F.exists(F.transform(b["items"], lambda x, k: (x["gap"] > 1) & (F.get(left, k) > F.get(ends, k))), lambda w: w)
        last = F.when(n == 0, 1).otherwise(F.get(left, n - 1) + F.length(F.get(b["items"], n - 1)["text"]) - 1)
        several = (n > 0) & ((left != right) | wide) | (b["tail"] > 1) & (last < F.length(s))
        return F.struct(ok.alias("ok"), F.when(ok, several).otherwise(False).alias("ambiguous"), left.alias("left"))

    return let(places(s, b), settle)


def captures(s: Column, b: Column, left: Column) -> Column:
    """What each placeholder takes, blocks standing at `left`."""
    n = F.size(b["items"])
    ended = lambda k: F.when(k == 0, F.lit(1)).otherwise(F.get(left, k - 1) + F.length(F.get(b["items"], k - 1)["text"]) - 1)
    token = lambda at: let(F.substring(s, F.lit(1), at), lambda x: F.length(x) - F.length(F.replace(x, F.lit(SEP), F.lit(""))) - 1)
    spans = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(F.when(k == n, b["tail"]).otherwise(F.get(b["items"], k)["gap"]).alias("gap"), ended(k).alias("lo"), F.when(k == n, F.length(s)).otherwise(F.get(left, k)).alias("hi")))
    each = F.flatten(F.transform(F.filter(spans, lambda x: x["gap"] > 0), lambda x: F.array_repeat(x, x["gap"])))
    text = lambda x: from_bytes(F.replace(F.substring(s, x["lo"], x["hi"] - x["lo"]), F.lit(SEP), F.lit("")))
    return F.transform(each, lambda x, k: F.struct(k.alias("placeholder"), token(x["lo"]).alias("token_begin"), token(x["hi"]).alias("token_end"), text(x).alias("value")))


def template_match(segs: Column, toks: Column) -> Column:
    """struct<accepted, ambiguous, captures>: captures only if there is one way."""

    def result(x):
        one = F.when(x["f"]["ok"] & ~x["f"]["ambiguous"], captures(x["s"], x["b"], x["f"]["left"]))
        return F.struct(x["f"]["ok"].alias("accepted"), x["f"]["ambiguous"].alias("ambiguous"), one.alias("captures"))

    with_fit = lambda x: F.struct(x["s"].alias("s"), x["b"].alias("b"), fit(x["s"], x["b"], x["r"]).alias("f"))
    with_back = lambda x: F.struct(x["s"].alias("s"), x["b"].alias("b"), turned(x["b"]).alias("r"))
    return let(let(let(F.struct(joined(toks).alias("s"), blocks(segs).alias("b")), with_back), with_fit), result)


def _keyed(templates: DataFrame) -> DataFrame:
    """Templates with what every line they accept must have: first and last token and a number of tokens."""
    words = F.aggregate("segs", F.lit(0), lambda a, s: a + F.size(s["toks"]))
    first, last = F.get("segs", F.lit(0)), F.try_element_at("segs", F.lit(-1))
    return templates.select(
        "label",
        "ordinal",
        "segs",
        words.alias("least"),
        F.when(F.size("segs") == 0, "").when(first["is_ph"], F.lit(None)).otherwise(F.get(first["toks"], F.lit(0))).alias("first"),
        F.when(~last["is_ph"], F.element_at(last["toks"], -1)).alias("last"),
        blocks(F.col("segs")).alias("b"),
    )


def candidates(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """lines (size, head, end, s, ...: number of tokens, first, last, all joined) joined with the templates that these allow."""
    t = _keyed(templates).withColumn("r", turned(F.col("b")))
    led = lines.join(t.where("first IS NOT NULL"), F.col("head") == F.col("first"))
    free = lines.join(t.where("first IS NULL"), F.col("size") >= F.col("least"))
    met = led.unionByName(free).where((F.col("size") >= F.col("least")) & (F.col("last").isNull() | (F.col("end") == F.col("last"))))
    # cheaper than placing them: all blocks have to occur somewhere
    return met.where(F.forall("b.items", lambda x: F.contains(F.col("s"), x["text"])))


def _expression(segs: list, capture: bool, backwards: bool = False) -> str:
    """A template as a regular expression over joined tokens, placeholders as short as may be.

    Forwards, a place is before a separator and captures begin with one;
    backwards, over the reversed line, it is behind one and captures end with
    one.  Without captures, blocks between placeholders are found for good.
    """
    edge = f"(?<={SEP})" if backwards else f"(?={SEP})"
    hole = f"(.*?){edge}" if capture else f".*?{edge}"
    quote = lambda t: re.escape(t[::-1] if backwards else t)
    word = (lambda t: quote(t) + SEP) if backwards else (lambda t: SEP + quote(t))
    parts: list[tuple[int, str]] = [(0, "")]  # placeholders, and the block behind them
    for is_ph, toks in reversed(segs) if backwards else segs:
        if is_ph:
            parts.append((1, "")) if parts[-1][1] or not parts[-1][0] else parts.append((parts.pop()[0] + 1, ""))
        else:
            gap, block = parts.pop()
            parts.append((gap, block + "".join(map(word, reversed(toks) if backwards else toks))))
    out = ""
    for k, (gap, block) in enumerate(parts):
        piece = hole * (gap if capture else min(gap, 1)) + block + (edge if block and not backwards else "")
        out += f"(?>{piece})" if not capture and gap and block and k < len(parts) - 1 else piece
    return rf"(?s)\A{SEP}{out}\z" if backwards else rf"(?s)\A{out}{SEP}\z"


def _ends(segs: list) -> tuple[str, str]:
    """What every accepted line begins and ends with, joined."""
    head = [] if not segs or segs[0][0] else list(segs[0][1])
    tail = [] if not segs or segs[-1][0] else list(segs[-1][1])
    return SEP + "".join(t + SEP for t in head), "".join(SEP + t for t in tail) + SEP


def literal_match(segs: list, s: Column) -> tuple[Column, Column, Column]:
    """(accepted, ambiguous, captures) of joined lines by one template; the latter two hold for accepted lines alone."""
    holes = sum(bool(p) for p, _ in segs)
    head, tail = _ends(segs)
    ok = F.startswith(s, F.lit(head)) & F.endswith(s, F.lit(tail)) & s.rlike(_expression(segs, False))
    if not holes:
        return ok, F.lit(False), F.array().cast(CAPTURES)
    groups = GROUP.join(f"${k}" for k in range(1, holes + 1))
    left = F.regexp_replace(s, F.lit(_expression(segs, True)), F.lit(groups))
    right = F.reverse(F.regexp_replace(F.reverse(s), F.lit(_expression(segs, True, True)), F.lit(groups)))
    several = F.lit(False) if holes == 1 else left != right
    before, n = [], 0
    for is_ph, toks in segs:
        if is_ph:
            before.append(n)
        else:
            n += len(toks)
    tokens_of = lambda g: F.length(g) - F.length(F.replace(g, F.lit(SEP), F.lit("")))

    def caught(parts):
        begin = lambda k: F.get(F.array(*map(F.lit, before)), k) + F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda a, g: a + tokens_of(g))
        return F.transform(parts, lambda g, k: F.struct(k.alias("placeholder"), begin(k).alias("token_begin"), (begin(k) + tokens_of(g)).alias("token_end"), from_bytes(F.replace(g, F.lit(SEP), F.lit(""))).alias("value")))

    return ok, several, let(F.split(left, GROUP, -1), caught).cast(CAPTURES)


def _option(label: int, ordinal: int, several: Column, caught: Column) -> Column:
    return let(several, lambda a: F.struct(F.lit(label).cast("long").alias("label"), F.lit(ordinal).alias("ordinal"), a.alias("ambiguous"), F.when(~a, caught).alias("captures")))


def _found(templates: list[tuple[int, int, list]], s: Column) -> Column:
    """array<struct<label, ordinal, ambiguous, captures>> of the templates (label, ordinal, segs) that accept a joined line, in their order."""
    kind = f"struct<label:bigint,ordinal:int,ambiguous:boolean,captures:{CAPTURES}>"
    options = []
    for label, ordinal, segs in sorted(templates, key=lambda t: t[1]):
        ok, several, caught = literal_match(segs, s)
        options.append(F.when(ok, _option(label, ordinal, several, caught).cast(kind)))
    return F.filter(F.array(*options).cast(f"array<{kind}>"), lambda m: m.isNotNull())


def _few(templates: DataFrame) -> list[tuple[int, int, list]] | None:
    """Templates on the driver if they are LITERAL at most, else None."""
    rows = templates.select("label", "ordinal", "segs").limit(LITERAL + 1).collect()
    return None if len(rows) > LITERAL else [(r.label, r.ordinal, [(x.is_ph, list(x.toks)) for x in r.segs]) for r in rows]


def _joined_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("s", joined(tokens(F.col("raw"))))


def accepted(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """(row_id, label, ordinal, ambiguous, captures): one row for each line and template that accepts it; lines (row_id, raw)."""
    if (few := _few(templates)) is not None:
        found = _joined_lines(lines.select("row_id", "raw")).select("row_id", F.explode(_found(few, F.col("s"))).alias("m"))
        return found.select("row_id", "m.label", "m.ordinal", "m.ambiguous", "m.captures")
    rows = lines.select("row_id", tokens(F.col("raw")).alias("toks"))
    rows = rows.select("row_id", F.size("toks").alias("size"), F.coalesce(F.get("toks", F.lit(0)), F.lit("")).alias("head"), F.coalesce(F.try_element_at("toks", F.lit(-1)), F.lit("")).alias("end"), joined(F.col("toks")).alias("s"))
    # exploding the fits that hold computes each once; a filter would be pushed below and compute it again
    fits = F.filter(F.array(fit(F.col("s"), F.col("b"), F.col("r"))), lambda f: f["ok"])
    found = candidates(rows, templates).withColumn("f", F.explode(fits))
    return found.select("row_id", "label", "ordinal", F.col("f.ambiguous").alias("ambiguous"), F.when(~F.col("f.ambiguous"), captures(F.col("s"), F.col("b"), F.col("f.left"))).alias("captures"))


def _shown(m: Column) -> Column:
    return F.struct(F.concat(F.lit("C"), m["label"].cast("string")).alias("template"), m["ambiguous"].alias("capture_ambiguous"), m["captures"].alias("captures"))


def match(lines: DataFrame, templates: DataFrame, explode: bool = False) -> DataFrame:
    """lines (row_id, source_line, raw) -> (line, message, matches), unmatched lines with an empty array; with explode, `accepted`."""
    if explode:
        return accepted(lines, templates)
    if (few := _few(templates)) is not None:
        return match_rows(lines, few).select(F.col("source_line").alias("line"), F.col("raw").alias("message"), "matches")
    item = F.struct("ordinal", F.struct("label", "ambiguous", "captures").alias("m"))
    per_line = accepted(lines, templates).groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: _shown(x["m"])).alias("matches"))
    empty = F.array().cast(MATCH)
    return lines.join(per_line, "row_id", "left").select(F.col("source_line").alias("line"), F.col("raw").alias("message"), F.coalesce(F.col("matches").cast(MATCH), empty).alias("matches"))


def match_rows(lines: DataFrame, templates: list) -> DataFrame:
    """lines (raw, ...) with `matches`, by columns alone: templates are (label, ordinal, segs) or (label, segs) in their order, few enough to be part of a plan."""
    few = [t if len(t) == 3 else (t[0], k, t[1]) for k, t in enumerate(templates)]
    held = _joined_lines(lines)
    return held.withColumn("matches", F.transform(_found(few, F.col("s")), _shown).cast(MATCH)).drop("s")


def template_text(templates: DataFrame) -> DataFrame:
    """templates with `text`, placeholders uncoloured."""
    return templates.withColumn("text", render_column(F.col("segs")))
