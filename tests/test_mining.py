import random

import pytest
from pyspark.sql import functions as F

from logweft.functions import tokens as T
from logweft.functions.distance import common_length, weighted
from logweft.functions.numbering import numbered
from logweft.operators import alignment, consensus, distances, evaluate, generalise, graph, modularity, outliers
from logweft.plans.mine import SelfCheckError, assemble_templates, mine
from logweft.plans.report import component_report, report
from logweft.sources import exports, reports
from logweft.sources.lines import prepare, read_lines, validated_content
from logweft.sources.templates import parse_body, parse_templates, templates_frame, templates_list

from . import model


def lines_frame(spark, texts):
    return spark.createDataFrame([(k, k + 1, t) for k, t in enumerate(texts)], "row_id long, source_line long, raw string")


def test_tokens(spark):
    rows = [("a1]: b$$x é\x01",), ("",)]
    got = spark.createDataFrame(rows, "s string").select(T.tokens(F.col("s")).alias("t"), T.signature(T.tokens(F.col("s"))).alias("g"), T.structure(T.tokens(F.col("s"))).alias("x")).collect()
    assert got[0].t == ["a", "1", "]:", " ", "b", "$$", "x", " ", "Ã©\x01"] and got[0].g == "A1D1@2S1A1$2A1S1N3" and got[1].t == []
    assert T.split_tokens("a1]: b$$x é\x01") == got[0].t and T.shown(got[0].t) == "a1]: b$$x é\x01"
    one = spark.createDataFrame([("x $GPGGA,1",), ("$GPG,",)], "s string").select(T.identifier(F.col("s")).alias("i")).collect()
    assert [r.i for r in one] == ["GPGGA", "UNKNOWN"]


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"  line {k} \n\n" for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = read_lines(spark, str(tmp_path / "a.log")).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.row_id, r.source_line, r.raw) for r in got] == [(k, 2 * k + 1, f"line {k}") for k in range(3000)]
    with pytest.raises(Exception):
        read_lines(spark, str(tmp_path / "none")).count()


def test_prepare(spark):
    content = "$A,1*00\\r\\n$B,2*01\r\nx $C\r\n$A,1*00"
    rows = spark.createDataFrame([(0, content)], "id int, value string")
    assert [r.record for r in prepare(rows, "id", "value").orderBy("pos").collect()] == ["$A,1*00", "$B,2*01", "$C", "$A,1*00"]
    assert "x $C" in [r.record for r in prepare(rows, "id", "value", True).collect()]
    for bad in ("none", "$a$b"):
        with pytest.raises(Exception):
            prepare(spark.createDataFrame([(0, bad)], "id int, value string"), "id", "value").collect()
    assert validated_content("$a\n$b\n") == ["$a", "$b"]
    for bad in ("$a", "$a\r\n", "a\n"):
        with pytest.raises(ValueError):
            validated_content(bad)


def test_structural_distance():
    rng = random.Random(4)
    sig = lambda: "".join(rng.choice("AD@S$N") + str(rng.randint(1, 3)) for _ in range(rng.randint(0, 7)))
    pairs = [(sig(), sig()) for _ in range(400)]
    import re

    parse = lambda s: [(c, int(n)) for c, n in re.findall(r"([AD@S$N])(\d+)", s)]
    got = weighted([a for a, _ in pairs], [b for _, b in pairs])
    assert got == pytest.approx([model.weighted_distance(tuple(parse(a)), tuple(parse(b))) for a, b in pairs])
    assert common_length(list("abcbdab"), list("bdcaba")) <= 4


def test_nearest_lines(spark):
    rng = random.Random(6)
    texts = [rng.choice(["a", "bb", "$x", "1"]) + " " * rng.randint(1, 2) + rng.choice(["12", "3", "c,d", ""]) + "x" for _ in range(40)]
    lines = lines_frame(spark, texts)
    d = {(r.i, r.j): r.d for r in distances.pair_distances(lines).collect()}
    want = {}
    for i in range(40):
        j = min((j for j in range(40) if j != i), key=lambda j: (d[i, j], j))
        want[i] = (j, d[i, j], max(d[i, k] for k in range(40)) - d[i, j])
    got = {r.i: (r.j, r.d, r.weight) for r in distances.one_nearest(lines).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i]), (i, texts[i])


def test_communities():
    two = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 0.1)]
    total = sum(w for *_, w in two)
    for refine in (True, False):
        label = modularity.optimise(two, total, refine=refine)
        assert len({label[v] for v in (0, 1, 2)}) == len({label[v] for v in (3, 4, 5)}) == 1 and label[0] != label[3]
    rng = random.Random(1)
    edges = [(a, b, rng.random()) for a in range(40) for b in range(a) if rng.random() < 0.1 or a // 10 == b // 10 and rng.random() < 0.6]
    label = modularity.optimise(edges, sum(w for *_, w in edges))
    assert modularity.modularity(edges, label) > modularity.modularity(edges, {v: 0 for v in label}) + 0.2


def test_graphs(spark):
    v = spark.range(8)
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 0.5), (5, 6, 2.0), (3, 3, 9.0)], "src long, dst long, weight double")
    assert sorted(map(tuple, graph.undirected(e).collect())) == [(0, 1, 0.5), (5, 6, 2.0)]
    label = {r.id: r.label for r in graph.connected_components(v, e).collect()}
    assert label == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 4, 7: 5}
    for algorithm in graph.ALGORITHMS:
        assert {r.id: r.label for r in graph.communities(v, e, algorithm).collect()} == label
    zero = e.withColumn("weight", F.lit(0.0))
    assert {r.id: r.label for r in graph.communities(v, zero, "leiden").collect()} == label
    assert [r.label for r in graph.connected_components(v, e.limit(0)).orderBy("id").collect()] == list(range(8))
    with pytest.raises(ValueError):
        graph.communities(v, e, "other")
    d = spark.createDataFrame([(i, j, float(abs(x - y))) for i, x in enumerate([0, 1, 2, 50, 51, 99]) for j, y in enumerate([0, 1, 2, 50, 51, 99])], "i long, j long, d double")
    assert {r.id: r.label for r in graph.dbscan(d, 1.5, 3).collect()} == {0: 0, 1: 0, 2: 0, 3: None, 4: None, 5: None}


def test_lof(spark):
    texts = ["kitten", "sitten", "sittin", "mitten", "kitten", "a very different line", "kit"]
    rows = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)] + [(100, 1, "x"), (101, 1, "y")], "row_id long, label long, raw string")
    import functools

    @functools.cache
    def lev(a, b):
        return len(b) if not a else len(a) if not b else min(lev(a[1:], b) + 1, lev(a, b[1:]) + 1, lev(a[1:], b[1:]) + (a[0] != b[0]))

    n = len(texts)
    k = {i: sorted(lev(texts[i], texts[j]) for j in range(n))[3] for i in range(n)}
    near = {i: [j for j in range(n) if j != i and lev(texts[i], texts[j]) <= k[i]] for i in range(n)}
    lrd = {i: 1 / max(sum(max(k[j], lev(texts[i], texts[j])) for j in near[i]) / len(near[i]), outliers.EPSILON) for i in range(n)}
    want = {i: sum(lrd[j] for j in near[i]) / len(near[i]) / lrd[i] for i in range(n)}
    got = {r.row_id: r.lof for r in outliers.lof(rows).collect()}
    assert got.pop(100) == got.pop(101) == 0.0 and got == pytest.approx(want)
    kept = outliers.retained(rows).orderBy("row_id").collect()
    assert [r.row_id for r in kept if r.excluded] == [i for i in range(n) if want[i] >= 1.5] and kept[0].local == 0


def test_alignment(spark):
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        found = alignment.runs_of(a, b)
        assert found == model.runs(a, b)
        chain = alignment.best_chain(found, len(a), len(b))
        costs = list(model.chains(found, len(a), len(b)))
        if len(found) == 1:
            assert chain == found
        elif not costs:
            assert chain == []
        else:
            assert chain in [c for cost, c in costs if cost == min(x for x, _ in costs)]
    base, ref = T.split_tokens("synchronized to 10.100.1.250, stratum 3"), T.split_tokens("synchronized to 10.100.22.250, stratum 3")
    b = spark.createDataFrame([(0, base)], "label long, tokens array<string>")
    r = spark.createDataFrame([(0, 1, ref)], "label long, ref_id long, tokens array<string>")
    got = [(x.b_start, x.r_start, x.len) for x in alignment.diagonal_segments(b, r).orderBy("b_start", "r_start").collect()]
    assert got == alignment.runs_of(base, ref)


def test_consensus(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for label in range(30):
        n = rng.choice([1, 2, 3, 9, 25])
        covered = {100 * label + k: [p for p in range(8) if rng.random() < (0.97 if p % 3 else 0.6)] for k in range(n)}
        want[label] = model.consensus(covered)
        rows += [(label, r, [(p, p, 1) for p in places]) for r, places in covered.items()]
    paths = spark.createDataFrame(rows, f"label long, ref_id long, path {alignment.PATH}")
    constants, out = consensus.consensus(paths)
    got = {r.label: r.places for r in constants.collect()}
    lost = {(r.label, r.ref_id) for r in out.collect()}
    assert {k: got.get(k, []) for k in want} == {k: v[0] for k, v in want.items()}
    assert lost == {(k, r) for k, v in want.items() for r in v[1]}


def test_generalise(spark):
    cases = [("A $0", "A $0", True), ("A $0 C", "A B C", True), ("A$0", "A", True), ("$0", "$0", True), ("A B", "A $0", True), ("A", "$0", True), ("A B C", "A $0", False), ("A $0", "A B", False), ("A", "A$0", False), ("$0", "A", False)]
    for base, ref, reaches in cases:
        assert generalise.walk(parse_body(base), parse_body(ref))[0] == reaches, (base, ref)
    t = templates_frame(spark, [(k, parse_body(x)) for k, x in enumerate(["A B", "A $0", "Z"])])
    cover = generalise.coverage(t)
    assert {(r.i, r.j) for r in cover.where("covered").collect()} == {(0, 1)}
    edges = generalise.generalisation_graph(cover)
    assert [(r.src, r.dst) for r in edges.collect()] == [(1, 0)]
    comp = generalise.refine(t, cover)
    assert {r.label: r.component for r in comp.collect()} == {0: 0, 1: 0, 2: 1}
    assert [(r.component, r.base) for r in generalise.merge_components(t, cover, comp, edges).collect()] == [(0, 0)]
    v, e = generalise.automaton(t)
    assert v.count() == 6 and {r.kind for r in e.collect()} == {"constant", "placeholder", "epsilon"}


LOG = [f"ntpd[{n}]: synchronized to 10.100.{a}.250, stratum {s}" for n, a, s in [(4100, 20, 3), (4101, 22, 3), (4102, 18, 3), (4103, 21, 3), (911, 7, 2), (912, 9, 2)]] + [f"user {u} logged in" for u in ("ann", "bob", "cleo", "dave")]


def test_two_passes(spark, tmp_path):
    lines = lines_frame(spark, LOG)
    result = mine(lines, "components")
    found = {r.text for r in result.assembled.templates.collect()}
    assert "user $0 logged in" in found
    assert result.labels.count() == len(LOG) and result.assembled.violations.isEmpty()
    text = report(result)
    assert parse_templates(text) == templates_list(result.assembled.templates)
    counts = reports.component_counts(text)
    assert sum(c.members for c in counts.values()) == len(LOG)
    assert set(reports.final_templates(text).values()) == found
    first = mine(lines, "leiden", passes=1)
    assert "Singletons:" in component_report(first) and first.assembled is first.first
    assert exports.weighted_graphml(first.assembled.templates.select(F.col("label").alias("id")), first.edges, True).count("<node") == first.assembled.templates.count()
    assert "style=dashed" in exports.automata_dot(templates_list(first.assembled.templates))
    again = mine(lines, "components")
    assert {r.text for r in again.assembled.templates.collect()} == found


def test_self_check(spark):
    lines = lines_frame(spark, ["a", "b a"])
    labels = spark.createDataFrame([(0, 0), (1, 0)], "row_id long, label long")
    with pytest.raises(SelfCheckError):
        assemble_templates(lines, labels)
    kept = assemble_templates(lines, labels, on_violation="quarantine")
    assert [r.row_id for r in kept.violations.collect()] == [1]
    alone = assemble_templates(lines, spark.createDataFrame([(0, 0), (1, 1)], "row_id long, label long"))
    assert [(r.text, r.is_catch_all) for r in alone.templates.orderBy("label").collect()] == [("$0", True), ("$0", True)]


def part(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "row_id long, label long")


def test_evaluation(spark):
    same = evaluate.partition_comparison(part(spark, [0, 0, 1, 1]), part(spark, [7, 7, 3, 3])).first()
    crossed = evaluate.partition_comparison(part(spark, [0, 0, 1, 1]), part(spark, [0, 1, 0, 1])).first()
    one = evaluate.partition_comparison(part(spark, [0]), part(spark, [5])).first()
    assert (same.equivalent, same.adjusted_rand_index) == (True, 1.0) and (crossed.equivalent, crossed.adjusted_rand_index) == (False, -0.5) and one.adjusted_rand_index == 1.0
    counts = evaluate.component_counts(part(spark, [0, 0, 0, 0, 0, 1, 1, 1]), spark.createDataFrame([(1,)], "row_id long"), spark.createDataFrame([(0,), (2,), (4,), (5,), (6,), (7,)], "row_id long"))
    r = counts.where("label = 0").first()
    assert (r.accidental, r.excluded, r.support) == (1, 2, 3)
    lines = lines_frame(spark, ["$GPGGA,1", "$GPRMC,1", "$GPRMC,2", "$GPRMC,3", "$GPRMC,3"])
    texts = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "label long, text string")
    a = evaluate.assignments(lines, part(spark, [0, 0, 1, 2, 2]), texts, spark.createDataFrame([(0,)], "row_id long"))
    assert [x.label for x in evaluate.mixed(a).collect()] == [0]
    assert {x.identifier: x.fragmented for x in evaluate.fragmentation(a).collect()} == {"GPGGA": False, "GPRMC": True}
    assert [(x.label, x.message) for x in evaluate.distinct_examples(a).where("label = 2").collect()] == [(2, "$GPRMC,3")]
    table = evaluate.template_rows(a, evaluate.component_counts(part(spark, [0, 0, 1, 2, 2]), lines.select("row_id").limit(0), lines.select("row_id"))).orderBy("template_label").first()
    assert table.identifier_counts_json == '{"GPGGA":1,"GPRMC":1}' and table.fragmented_identifiers == "GPRMC" and table.mixed_identifier == "true"
    with pytest.raises(ValueError):
        evaluate.assignments(lines, part(spark, [0, 0, 1, 9, 9]), texts, lines.select("row_id"))
    j = evaluate.template_jaccard(texts.select("text"), spark.createDataFrame([("a",), ("z",)], "text string")).first()
    assert (j.shared, j["all"], j.jaccard) == (1, 4, 0.25)


def test_shuffle(spark):
    lines = lines_frame(spark, [f"r{k}" for k in range(20)])
    x = evaluate.shuffled(lines, 20260710)
    rows = x.orderBy("new_id").collect()
    assert [r.new_id for r in rows] == list(range(20)) and sorted(r.row_id for r in rows) == list(range(20)) and [r.row_id for r in rows] != list(range(20))
    order, labels = [2, 0, 3, 1], [4, 9, 4, 9]
    row_map = spark.createDataFrame(list(enumerate(order)), "new_id long, row_id long")
    back = evaluate.restored(part(spark, labels), row_map)
    assert {r.row_id: r.label for r in back.collect()} == {2: 4, 0: 9, 3: 4, 1: 9}
    with pytest.raises(ValueError):
        evaluate.checked_row_map(spark.createDataFrame([(0, 0), (1, 0)], "new_id long, row_id long"))


def test_numbers(spark):
    got = numbered(spark.range(1000).selectExpr("(id * 7919) % 1000 AS v"), ["v"], "n").collect()
    assert all(r.v == r.n for r in got) and len(got) == 1000


def test_integer_rows(spark, tmp_path):
    assert exports.read_integer_row(exports.write_integer_row([3, 0, 7])) == [3, 0, 7]
    for bad in (b"X\n1 0\n", b"ARMA_MAT_BIN_IU008\n2 1\n" + b"\0" * 16, b"ARMA_MAT_BIN_IU008\n1 1\n" + b"\xff" * 8, b"ARMA_MAT_BIN_IS008\n1 1\n" + b"\xff" * 8):
        with pytest.raises(ValueError):
            exports.read_integer_row(bad)
    (tmp_path / "x").write_bytes(exports.write_integer_row([5, 6]))
    assert [(r.row_id, r.label) for r in exports.label_rows(spark, str(tmp_path / "x")).collect()] == [(0, 5), (1, 6)]


def test_reports_are_checked():
    good = "Label: C0 (2)\nContributors C0: 0\n    Excluded 1\n"
    c = reports.component_counts(good)[0]
    assert (c.members, c.lof_excluded, c.support, c.accidental, c.excluded) == (2, 1, 1, 0, 1)
    for bad in ("", "Contributors C0: 1\n", good + "Label: C0 (1)\n", "Label: C0 (1)\nContributors C0: x\n", "Label: C0 (1)\n Excluded 2\n", "Label: C0 (2)\nContributors C0: 1 1\n", "Label: C0 (1)\nContributors C0: 1\nLabel: C1 (1)\n"):
        with pytest.raises(ValueError):
            reports.component_counts(bad)
    with pytest.raises(ValueError):
        reports.result_path("/tmp/a", "../b")
    assert reports.manifest_value({"a": {"b": 1}}, ["x", "a.b"]) == 1


def test_command_line_and_experiment(spark, tmp_path, capsys):
    import json

    from logweft.cli import main
    from logweft.plans.experiment import Run, experiment, run_matrix, select_runs

    (tmp_path / "log").write_text("\n".join(LOG) + "\n")
    assert main(["mine", str(tmp_path / "log"), "-C", "components", "--plain", "--output", str(tmp_path / "out")], spark) == 0
    (tmp_path / "report").write_text(capsys.readouterr().out)
    assert main(["match", "--templates", str(tmp_path / "report"), "--input", str(tmp_path / "log"), "--output", str(tmp_path / "m")], spark) == 0
    assert all(json.loads(x)["matches"] for x in (tmp_path / "m").read_text().splitlines())
    (tmp_path / "raw").write_text("a $GPGGA,1\\r\\n$GPGGA,2\n")
    assert main(["prepare", str(tmp_path / "raw"), str(tmp_path / "ready")], spark) == 0
    assert (tmp_path / "ready").read_text() == "$GPGGA,1\n$GPGGA,2\n"
    (tmp_path / "trace").write_text("".join(f"$GPGGA,{k},N\n" for k in range(6)))
    found = experiment(spark, [Run("R01", str(tmp_path / "trace")), Run("R08", str(tmp_path / "trace"), shuffle_seed=1)], str(tmp_path / "x"), cluster_algo="components", on_violation="quarantine")
    assert found["comparisons"][0]["messages_compared"] == 6 and found["skipped_comparisons"] == [["R01", "R07"], ["R06", "R09"]]
    assert json.loads((tmp_path / "x" / "R01" / "summary.json").read_text())["identifier_counts"] == {"GPGGA": 6}
    from logweft.plans.experiment import stored_run

    stored = stored_run(spark, str(tmp_path / "x"), "R08")
    assert {r.row_id for r in stored.labels.collect()} == set(range(6)) and sum(c.members for c in stored.counts.values()) == 6 and stored.templates.keys() == stored.counts.keys()
    with pytest.raises(OSError):
        stored_run(spark, str(tmp_path / "x"), "R09")
    runs = run_matrix("a", "b", ["c", "d", "e"], "f", "g")
    assert [r.run_id for r in runs] == [f"R0{k}" for k in range(1, 10)] and runs[5].path == "f" and [r.run_id for r in select_runs(runs, ["R02"])] == ["R02"]


def test_structural_distances_take_suppliers_and_nations(spark):
    from logweft.queries import structural_distances

    text = {r.n_nationkey: r.n_name for r in spark.read.parquet("/root/testdata/sf0.001/nation.parquet").collect()}
    text |= {-r.s_suppkey - 1: r.s_name for r in spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").collect()}
    sig = {r.i: r.s for r in spark.createDataFrame(list(text.items()), "i long, raw string").select("i", T.signature(T.tokens(F.col("raw"))).alias("s")).collect()}
    got = {(r.i, r.j): r.d for r in structural_distances(spark, "/root/testdata/sf0.001").collect()}
    assert got == {(i, j): pytest.approx(weighted([sig[i]], [sig[j]])[0], abs=1e-8) for i in text for j in text if i < j}
