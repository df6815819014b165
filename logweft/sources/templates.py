"""Templates as text, and as a DataFrame.

A template is a list of segments (is_ph, tokens).  Text form: constants as they
are, placeholder n as `$n`, coloured or not.  Tables (Parquet, JSON) are the
primary form, as plain text cannot tell a literal `$0` from a placeholder.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import ANSI, BULLET_COLOUR, PALETTE, RESET, from_bytes, shown, split_tokens

SCHEMA = "label long, ordinal int, segs array<struct<is_ph:boolean,toks:array<string>>>"
Segment = tuple[bool, list[str]]
_SUMMARY = re.compile(r"Summary: (\d+) clusters")
_LINE = re.compile(r"\s*C(0|[1-9]\d*)(?: (.*))?", re.S)
_BULLET = re.compile(rf"(?:{ANSI})*●(?:{ANSI})* ?")
_NUMBER = r"(0|[1-9]\d*)"


class TemplateError(ValueError):
    """The text is not a valid template summary."""


def placeholder(n: int, colour: bool = True) -> str:
    return f"{PALETTE[n % len(PALETTE)]}${n}{RESET}" if colour else f"${n}"


def render(segs: list[Segment], colour: bool = True) -> str:
    out, n = [], 0
    for is_ph, toks in segs:
        out.append(placeholder(n, colour) if is_ph else shown(toks))
        n += is_ph
    return "".join(out)


def placeholder_column(n: Column, colour: bool = False) -> Column:
    """Placeholder n as text."""
    text = F.concat(F.lit("$"), n.cast("string"))
    return F.concat(F.get(F.array(*map(F.lit, PALETTE)), n % len(PALETTE)), text, F.lit(RESET)) if colour else text


def render_column(segs: Column, colour: bool = False) -> Column:
    """Text of a template column, uncoloured unless asked."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(F.concat(a["text"], F.when(s["is_ph"], placeholder_column(a["n"], colour)).otherwise(from_bytes(F.array_join(s["toks"], "")))).alias("text"), (a["n"] + s["is_ph"].cast("int")).alias("n"))
    return F.aggregate(segs, start, step, lambda a: a["text"])


def parse_body(body: str) -> list[Segment]:
    """Segments of a template's text; with any escape in it only coloured placeholders count."""
    coloured = "\x1b" in body
    pattern = re.compile(rf"({ANSI})\${_NUMBER}({ANSI})" if coloured else r"\$(\d+)")
    segs: list[Segment] = []
    at = n = 0

    def constant(text: str):
        if "\x1b" in text:
            raise TemplateError("stray terminal escape in a template")
        if text:
            segs.append((False, split_tokens(text)))

    for m in pattern.finditer(body):
        number = m[2] if coloured else m[1]
        if number != str(n):
            raise TemplateError(f"placeholder ${number} where ${n} is due")
        if coloured and (m[1] != PALETTE[n % len(PALETTE)] or m[3] != RESET):
            raise TemplateError(f"placeholder ${n} has the wrong colour or no reset")
        constant(body[at : m.start()])
        segs.append((True, []))
        at, n = m.end(), n + 1
    rest = body[at:]
    if coloured and rest.endswith(RESET) and "\x1b" not in rest[: -len(RESET)]:
        rest = rest[: -len(RESET)]
    constant(rest)
    return segs


def parse_templates(text: str) -> list[tuple[int, list[Segment]]]:
    """(label, segments) of the last cluster summary in a report."""
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    plain = [re.sub(ANSI, "", x).strip() for x in lines]
    heads = [i for i, x in enumerate(plain) if _SUMMARY.fullmatch(x)]
    if not heads:
        raise TemplateError("no cluster summary")
    want = int(_SUMMARY.fullmatch(plain[heads[-1]])[1])
    out: list[tuple[int, list[Segment]]] = []
    for line, bare in zip(lines[heads[-1] + 1 :], plain[heads[-1] + 1 :]):
        if not bare.strip("-"):
            continue
        m = _LINE.fullmatch(line)
        if len(out) == want:
            raise TemplateError("output of a first pass: components follow the templates" if bare.endswith("components") else f"more than {want} templates, or text after them")
        if not m:
            raise TemplateError(f"not a template line: {bare!r}")
        label, body = int(m[1]), m[2] or ""
        if label in {k for k, _ in out}:
            raise TemplateError(f"label C{label} appears twice")
        out.append((label, parse_body(_BULLET.sub("", body, 1) if _BULLET.match(body) else body)))
    if len(out) < want:
        raise TemplateError(f"{len(out)} templates where {want} are due")
    return out


def render_templates(templates: list[tuple[int, list[Segment]]], colour: bool = True) -> str:
    """The summary block that parse_templates reads."""
    rule = "-" * 28
    bullet = f"{BULLET_COLOUR}●{RESET} " if colour else ""
    body = [f"{f'C{label}':>4} {bullet}{render(segs, colour)}" for label, segs in templates]
    return "\n".join([rule, f"Summary: {len(templates)} clusters", rule, *body, ""])


def templates_frame(spark: SparkSession, templates: list[tuple[int, list[Segment]]]) -> DataFrame:
    return spark.createDataFrame([(label, n, [(bool(p), t) for p, t in segs]) for n, (label, segs) in enumerate(templates)], SCHEMA)


def templates_list(templates: DataFrame) -> list[tuple[int, list[Segment]]]:
    """Templates on the driver, in their order: for reports and exports, whose size a reader can take in."""
    return [(r.label, [(s.is_ph, list(s.toks)) for s in r.segs]) for r in templates.orderBy("ordinal").collect()]
