import itertools
import json
import os

import pytest
from pyspark.sql import functions as F

from logweft.functions.tokens import split_tokens
from logweft.operators import matching
from logweft.operators.matching import joined, literal_match, match, match_rows, template_match
from logweft.plans.match import json_lines, match_file
from logweft.sources.templates import SCHEMA, TemplateError, parse_templates, placeholder, render, render_templates, templates_frame

from .model import accepts

PH = (True, [])


def lit(text):
    return (False, split_tokens(text))


def results(spark, pairs):
    rows = [(k, [(p, t) for p, t in segs], split_tokens(line)) for k, (segs, line) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "k int, segs array<struct<is_ph:boolean,toks:array<string>>>, toks array<string>")
    return [r.m for r in df.select("k", template_match(F.col("segs"), F.col("toks")).alias("m")).orderBy("k").collect()]


def test_published_cases(spark):
    cases = [
        ([lit("$GGA,")], "$GGA,", True, False, []),
        ([lit("$GGA,")], "$RMC,", False, False, None),
        ([lit("$GGA,")], "0$GGA,", False, False, None),
        ([lit("$GGA,")], "$GGA,0", False, False, None),
        ([lit("A"), PH], "AB", False, False, None),
        ([lit("$A"), PH, lit(",B")], "$A12,B", True, False, [(2, 3, "12")]),
        ([PH, lit("$A")], "12$A", True, False, [(0, 1, "12")]),
        ([lit("$A"), PH], "$A,12", True, False, [(2, 4, ",12")]),
        ([lit("$A"), PH, lit(","), lit("B")], "$A,B", True, False, [(2, 2, "")]),
        ([lit("$A"), PH, lit(","), lit("B")], "$A,B$,B", True, False, [(2, 5, ",B$")]),
        ([PH, lit(","), PH], "$A,$B,", True, True, None),
        ([PH], "$A,12", True, False, [(0, 4, "$A,12")]),
        ([PH], "", True, False, [(0, 0, "")]),
        ([PH, PH], "$A", True, True, None),
        ([PH, PH], "", True, False, [(0, 0, ""), (0, 0, "")]),
        ([], "", True, False, []),
        ([], "$A", False, False, None),
    ]
    for (segs, line, ok, ambiguous, captures), m in zip(cases, results(spark, [c[:2] for c in cases])):
        assert (m.accepted, m.ambiguous) == (ok, ambiguous), (segs, line)
        got = None if m.captures is None else [(c.token_begin, c.token_end, c.value) for c in m.captures]
        assert got == captures, (segs, line)


def test_every_small_template_and_line(spark):
    letters = ["A", "B", "1", "$"]
    kinds = {"A": "a", "B": "a", "1": "d", "$": "p"}
    lines = [t for n in range(5) for t in itertools.product(letters, repeat=n) if all(kinds[a] != kinds[b] for a, b in zip(t, t[1:]))]
    shapes = [()]
    for n in range(1, 6):
        for first in (True, False):
            slots = [first ^ bool(k % 2) for k in range(n)]
            for consts in itertools.product(letters, repeat=slots.count(False)):
                it = iter(consts)
                shapes.append(tuple((True, ()) if s else (False, (next(it),)) for s in slots))
    shapes += [((True, ()), (True, ()), (False, ("A",))), ((False, ("A",)), (True, ()), (True, ())), ((False, ("A",)), (False, ("1",)), (True, ()))]
    t = spark.createDataFrame([(k, [(p, list(c)) for p, c in s]) for k, s in enumerate(shapes)], "t int, segs array<struct<is_ph:boolean,toks:array<string>>>")
    x = spark.createDataFrame([(k, list(v)) for k, v in enumerate(lines)], "l int, toks array<string>")
    got = t.crossJoin(x).select("t", "l", template_match(F.col("segs"), F.col("toks")).alias("m")).select("t", "l", "m.*").collect()
    assert len(got) == len(shapes) * len(lines)
    # the same by expressions that are part of the plan
    for at in range(0, len(shapes), 150):
        columns = []
        for k, shape in enumerate(shapes[at : at + 150], at):
            ok, several, caught = literal_match([(p, list(c)) for p, c in shape], F.col("s"))
            columns.append(F.struct(F.lit(k).alias("t"), ok.alias("accepted"), (ok & several).alias("ambiguous"), F.when(ok & ~several, caught).alias("captures")))
        got += x.withColumn("s", joined(F.col("toks"))).select("l", F.explode(F.array(*columns)).alias("m")).select("m.t", "l", "m.accepted", "m.ambiguous", "m.captures").collect()
    assert len(got) == 2 * len(shapes) * len(lines)
    for r in got:
        ways = accepts([(p, list(c)) for p, c in shapes[r.t]], list(lines[r.l]), 2)
        assert (r.accepted, r.ambiguous) == (bool(ways), len(ways) > 1), (shapes[r.t], lines[r.l])
        assert (r.captures is None) == (len(ways) != 1)
        if len(ways) == 1:
            assert [(c.token_begin, c.token_end, c.value) for c in r.captures] == [(a, b, "".join(lines[r.l][a:b])) for a, b in ways[0]]


GOLDEN = """----------------------------
Summary: 2 clusters
----------------------------
C3 $A,$0,B
C7 $A$0
"""
EXPECTED = (
    '{"line":1,"message":"$A,12,B","matches":[{"template":"C3","capture_ambiguous":false,"captures":[{"placeholder":0,"token_begin":3,"token_end":4,"value":"12"}]},'
    '{"template":"C7","capture_ambiguous":false,"captures":[{"placeholder":0,"token_begin":2,"token_end":6,"value":",12,B"}]}]}\n'
    '{"line":3,"message":"$X","matches":[]}\n'
)


def test_file_to_json_lines(spark, tmp_path):
    t, i, o = tmp_path / "t.txt", tmp_path / "i.txt", tmp_path / "o.jsonl"
    t.write_text(GOLDEN)
    i.write_text("  $A,12,B  \n\n$X\n")
    match_file(spark, str(t), str(i), str(o))
    assert o.read_text() == EXPECTED
    assert sorted(os.listdir(tmp_path)) == ["i.txt", "o.jsonl", "t.txt"]
    os.link(i, tmp_path / "link")
    for bad in (i, t, tmp_path / "link"):
        with pytest.raises(ValueError):
            match_file(spark, str(t), str(i), str(bad))
    assert i.read_text().endswith("$X\n")


def test_json_of_odd_text(spark):
    lines = spark.createDataFrame([(0, 1, 'a\x1b"\\é\\u001B\x0b'), (1, 2, "x")], "row_id long, source_line long, raw string")
    t = templates_frame(spark, [(0, [PH]), (1, [PH, PH])])
    rows = [r.value for r in json_lines(match(lines, t)).orderBy("line").collect()]
    assert "\\u001b" in rows[0] and "\\\\u001B" in rows[0] and "\\u000b" in rows[0]
    assert json.loads(rows[0])["message"] == 'a\x1b"\\é\\u001B\x0b' and json.loads(rows[0])["matches"][1]["captures"] is None


def test_joined_and_literal_templates_agree(spark, monkeypatch):
    texts = ["a 1 b", "a b", "", "é 1", "a  b", "a.*b (c) \\E [d] $e", "x" * 3000 + " b" * 3000, "a\x1e 1 \x1f b", "b b b b b b"]
    lines = spark.createDataFrame([(k, k + 1, t) for k, t in enumerate(texts)], "row_id long, source_line long, raw string")
    templates = [(0, [lit("a "), PH, lit(" b")]), (1, [PH]), (5, [PH, lit(" "), PH]), (6, [lit("a.*"), PH, lit("\\E [d] $"), PH]), (7, []), (8, [PH, lit("b"), PH, lit("b"), PH, lit("b")]), (9, [lit("b b"), PH, lit("b b b b")]), (10, [PH, PH, lit("b")])]
    frame = templates_frame(spark, templates)
    a = {r.message: r.matches for r in match(lines, frame).collect()}
    b = {r.raw: r.matches for r in match_rows(lines, templates).collect()}
    monkeypatch.setattr(matching, "LITERAL", 3)
    c = {r.message: r.matches for r in match(lines, frame).collect()}
    assert a == b == c and sum(map(len, a.values())) > 15


def test_matching_does_not_move_lines(spark):
    lines = spark.range(100).selectExpr("id AS row_id", "id + 1 AS source_line", "concat('a ', id) AS raw")
    found = match(lines, templates_frame(spark, [(0, [lit("a "), PH])]))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_streamed_matches(spark, tmp_path):
    from logweft.streaming import match_folder

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("$A,12,B\n\n$X\n")
    q = match_folder(spark, str(tmp_path / "in"), parse_templates(GOLDEN), str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    got = {r.value for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert {json.loads(x)["message"]: len(json.loads(x)["matches"]) for x in got} == {"$A,12,B": 2, "$X": 0}


def block(*lines, n=None):
    rule = "-" * 28
    return "\n".join([rule, f"Summary: {len(lines) if n is None else n} clusters", rule, *lines, ""])


def test_template_text():
    segs = [(7, [lit("$"), PH, lit("*"), PH]), (42, [lit(" x$0 "), PH])]
    assert parse_templates("noise\n" + block("C1 a") + render_templates(segs)) == segs
    assert parse_templates(block("C1 $$0*$1").replace("\n", "\r\n")) == [(1, [lit("$"), PH, lit("*"), PH])]
    coloured = f"C1 $0{placeholder(0)}$1"
    assert parse_templates(block(coloured)) == [(1, [lit("$0"), PH, lit("$1")])]
    assert render([lit("a"), PH], False) == "a$0"
    for bad in (
        "C1 a\n",
        block("C1 a", n=2),
        block("C1 a", "C2 b", n=1),
        block("C1 a", "C1 b"),
        block(f"C1 {placeholder(1)}{placeholder(0)}"),
        block("C1 \x1b[0;31m$0"),
        block("C1 $1$0"),
        block("C1 $01"),
        block("C1 a") + block().replace("clusters", "components"),
    ):
        with pytest.raises(TemplateError):
            parse_templates(bad)


def test_template_schema(spark):
    assert templates_frame(spark, []).count() == 0 and "segs" in SCHEMA
