"""What larger tables and copies brought to light."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweft.functions import levenshtein
from logweft.functions.distance import weighted
from logweft.functions.levenshtein import levenshtein_table
from logweft.functions.numbering import checkpointed
from logweft.operators import distances, graph, outliers, tiles
from logweft.sources import exports
from logweft.sources.lines import lines_of

from .test_operators import edit_distance


def test_nearest_lines_of_few_signatures(spark):
    """A thousand lines of two signatures: their nearest lines, kept."""
    x = lines_of(spark.read.parquet("/root/testdata/sf0.1/supplier.parquet"), "s_suppkey", "concat('supplier ', s_name, ' in nation ', s_nationkey)")
    got = {r.i: (r.j, r.d) for r in checkpointed(distances.one_nearest(x)).collect()}
    sigs = {r.row_id: r.sig for r in distances.line_signatures(x).collect()}
    assert len(got) == 1000 and len(set(sigs.values())) == 2
    assert all(got[i] == (min(j for j in sigs if j != i and sigs[j] == s), 0.0) for i, s in sigs.items())


def test_short_edit_distances():
    rng = random.Random(3)
    for most in (0, 3, 8, 9, 16, 17, 33, 64):
        text = lambda: b"head" + bytes(rng.choice(b"abc") for _ in range(rng.choice([0, most // 2, most]))) + b"tail"  # noqa: B023,E731
        a, b = [text() for _ in range(9)], [text() for _ in range(7)] + [b"x" * 300] * (most == 33)
        for d in (levenshtein_table(a, b), levenshtein_table(a, b, True), levenshtein_table(b, a, True).T):
            assert all(d[i, j] == edit_distance(x, y) for i, x in enumerate(a) for j, y in enumerate(b))
    assert levenshtein_table([], [b"a"]).shape == (0, 1)


@pytest.fixture
def named(spark, monkeypatch):
    """Rows with copies, near copies and an empty text over many tiles, and their whole square."""
    monkeypatch.setattr(tiles, "TILE", 4)
    rng = random.Random(5)
    rows = [(3 * k + 1, "".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 4, 5, 6, 9])))) for k in range(40)]
    df = spark.createDataFrame(rows, "key long, name string")
    dist = spark.createDataFrame([(i, j, float(edit_distance(a.encode(), b.encode()))) for i, a in rows for j, b in rows], "i long, j long, d double")
    return df, dist, rows


def same(left, right):
    return sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, right.select(*left.columns).collect()), key=str)


@pytest.mark.parametrize("k", [1, 3])
def test_knn_graph_of_texts(named, k):
    df, dist, _ = named
    assert same(tiles.nearest_edges(df, "key", "name", k), graph.directed_knn(dist, k))


def test_graphml_edges_alone(spark):
    """Whoever asks for a graph file's edges runs no task for its other lines."""
    x = exports.graphml_lines(spark.range(3).select("id", F.lit("a").alias("label")), spark.range(2).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0.0).alias("weight")))
    plan = x.where("part = 2")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "Union" not in plan, plan
    assert [r.line[:9] for r in x.orderBy("part", "a", "b").collect()][:2] == ["<?xml ver", "<graphml "]


def test_communities_are_found_once(spark, monkeypatch):
    """Each component is looked at once, and not all of them in one task."""
    seen, parts = spark.sparkContext.accumulator(0), []
    find = graph.modularity_groups

    def counted(inner, *args):
        found = find(inner, *args)
        parts.append(found.rdd.getNumPartitions())

        def count(batches):
            for x in batches:
                seen.add(len(x))
                yield x

        return found.mapInPandas(count, found.schema)

    monkeypatch.setattr(graph, "modularity_groups", counted)
    edges = spark.range(40).select((F.col("id") * 2).alias("src"), (F.col("id") * 2 + 1).alias("dst"), F.lit(1.0).alias("weight"))
    got = graph.communities(spark.range(81).select("id"), edges, "leiden").collect()
    assert {(r.id, r.label) for r in got} == {(k, k // 2) for k in range(81)}
    assert seen.value == 80
    assert parts == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def test_components_of_nearest_texts(named):
    df, dist, _ = named
    ids = df.select(F.col("key").alias("id"))
    assert same(graph.connected_components(ids, graph.undirected(tiles.nearest_edges(df, "key", "name"))), graph.connected_components(ids, graph.knn_graph(dist, 1)))


def test_graphml_of_nearest_texts(named):
    df, dist, _ = named
    ids = df.select(F.col("key").alias("id"))
    assert exports.weighted_graphml(ids, graph.undirected(tiles.nearest_edges(df, "key", "name"))) == exports.weighted_graphml(ids, graph.knn_graph(dist, 1))


def test_leiden_of_nearest_texts(named):
    df, dist, _ = named
    ids = df.select(F.col("key").alias("id"))
    assert same(graph.communities(ids, graph.undirected(tiles.nearest_edges(df, "key", "name", 3))), graph.communities(ids, graph.knn_graph(dist, 3)))


@pytest.mark.parametrize("eps, points", [(1.0, 4), (0.0, 2), (2.5, 9)])
def test_dbscan_of_texts(named, eps, points):
    df, dist, _ = named
    assert same(graph.dbscan_texts(df, "key", "name", eps, points), graph.dbscan(dist, eps, points))


def test_soft_neighbours_of_texts(named, monkeypatch):
    df, dist, _ = named
    monkeypatch.setattr(graph, "SOFT_LIST", 1)  # lists run out and grow
    for k in (1, 2):
        assert same(graph.soft_texts(df, "key", "name", k), graph.soft_knn(dist, k))


def test_squares_of_texts(named):
    df, dist, rows = named
    got = {(r.i, r.j): r.d for r in distances.character_distances(df, "key", "name").collect()}
    assert got == {(r.i, r.j): r.d for r in dist.collect() if r.i < r.j}
    assert same(distances.character_similarity(df, "key", "name"), distances.row_similarity(dist))


def test_squares_leave_tiles_in_blocks(named):
    """A worker sends ids once a block, not three or four columns a pair."""
    df, dist, rows = named
    for x in (distances.character_distances(df, "key", "name"), distances.character_similarity(df, "key", "name")):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate posexplode(d" in plan


def test_farthest_by_largest_distances_alone(named, monkeypatch):
    df, dist, rows = named
    monkeypatch.setattr(tiles, "nearest_texts", None)  # no list of neighbours is made
    far = {r.i: r.far for r in dist.groupBy("i").agg(F.max("d").cast("long").alias("far")).collect()}
    got = {r.id: r.far for r in tiles.farthest(tiles.distinct_texts(df, "key", "name")).collect()}
    assert got and all(far[i] == d for i, d in got.items())


def test_distances_are_rounded_once_a_signature(spark):
    values = [0.0, 1.0, 1 / 3, 2 / 3, 0.1234567895, 0.0000000005, 1.0000000015, 5e-10 - 1e-20, 12345.6789012345]
    want = [r.d for r in spark.createDataFrame([(x,) for x in values], "x double").select(F.round("x", 9).alias("d")).collect()]
    assert distances.rounded(np.array([values]), 9).tolist() == [want]
    x = spark.createDataFrame([(k, k, f"{'a' * (k % 4 + 1)} {'7' * (k % 3 + 1)}") for k in range(12)], "row_id long, source_line long, raw string")
    found = distances.pair_distances(x, half=True, digits=2)
    assert "round(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(found.collect()) == sorted(distances.pair_distances(x, half=True).select("i", "j", F.round("d", 2).alias("d")).collect())


def test_square_of_one_signature(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 4)
    x = spark.createDataFrame([(k, k, f"a{k:03}" if k % 5 else f"b-{k}") for k in range(30)], "row_id long, source_line long, raw string")
    sig = {r.row_id: r.sig for r in distances.line_signatures(x).collect()}
    whole = {(i, j): 0.0 if i == j else float(weighted([sig[i]], [sig[j]])[0]) for i in sig for j in sig}
    assert {(r.i, r.j): r.d for r in distances.pair_distances(x).collect()} == whole
    assert {(r.i, r.j): r.d for r in distances.pair_distances(x, half=True).collect()} == {k: d for k, d in whole.items() if k[0] < k[1]}


def test_lof_of_clusters_in_one_task(spark, monkeypatch):
    """Clusters of short texts need no pass over all pairs, have the same factors, and go to the passes where they do not fit."""
    rng = random.Random(8)
    text = lambda k: "n" * (k % 40 == 1) + f"Name#{rng.randrange(400):04}" if k % 50 else f"Name#{'z' * rng.choice([1, 9])}{k}"
    rows = [(k, k % 2, text(k)) for k in range(300)] + [(1000 + k, 5, f"{k * 7919:040b}") for k in range(30)]
    df = spark.createDataFrame(rows, "row_id long, label long, raw string")
    want = {r.row_id: r.lof for r in outliers.lof(df).collect()}
    monkeypatch.setattr(outliers, "ALONE", (2, 1 << 16))
    passes, given = outliers._by_passes, []
    monkeypatch.setattr(outliers, "_by_passes", lambda x, k: given.append({r.label for r in x.select("label").distinct().collect()}) or passes(x, k))
    got = {r.row_id: r.lof for r in outliers.lof(df).collect()}
    assert given == [{5}]
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    outliers.lof(df.where("label < 2")).collect()
    assert len(given) == 1


@pytest.mark.parametrize("limit", ["PAIRS", "COMPARED"])
def test_clusters_too_large_for_a_task(monkeypatch, limit):
    texts, m = [b"%03d" % k for k in range(50)] + [b"x" * 12], np.ones(51, np.int64)
    assert outliers._factors(texts, m, 3) is not None
    monkeypatch.setattr(outliers, limit, 8)
    assert outliers._factors(texts, m, 3) is None


def test_report_lines_that_count(spark):
    """Counts come from few lines of a report, which are chosen where the report is made."""
    from logweft.plans.mine import MineResult, assemble_templates
    from logweft.plans.report import cluster_report
    from logweft.sources import reports

    odd = ["Label: C3 (4)", "a b", "La\x1b[1mbel: C7 (1)", "    Excluded 2"]
    lines = spark.createDataFrame([(k, k, odd[k // 2] if k in (0, 4) else f"name {k:03} of") for k in range(40)], "row_id long, source_line long, raw string")
    found = assemble_templates(lines, lines.select("row_id", (F.col("row_id") % 3).alias("label")), on_violation="quarantine")
    result = MineResult(lines, found.contributors, found, None)
    whole, few = list(cluster_report(result, False)), list(cluster_report(result, False, reports.may_count))
    assert few == [x for x in whole if x in few] and len(few) < len(whole) / 2
    assert [x for x in few if reports.plain(x) != x] == [x for x in whole if "\x1b" in x]
    clean = lambda x: reports.component_counts("\n".join(y for y in x if "\x1b" not in y))
    assert clean(few) == clean(whole)


def test_lof_compares_short_texts_in_tiles(spark, monkeypatch):
    """Tiles of sorted texts: a text's tie of neighbours spreads over several, and distances are small numbers."""
    rng = random.Random(6)
    rows = [(k, k % 2, f"Name#{rng.randrange(300):06}" if k % 9 else "x" * 300) for k in range(120)]
    df = spark.createDataFrame(rows, "row_id long, label long, raw string")
    seen = []
    monkeypatch.setattr(outliers, "TILE", 16)
    inner = outliers.spread
    monkeypatch.setattr(outliers, "spread", lambda x, *keys: seen.append(x.columns) or inner(x, *keys))
    got = {r.row_id: r.lof for r in outliers.lof(df).collect()}
    assert seen and all("text" not in c for c in seen)  # tiles move whole, not a row a text and tile
    for label in (0, 1):
        mine = [(i, t.encode()) for i, b, t in rows if b == label]
        d = {(i, j): edit_distance(a, b) for i, a in mine for j, b in mine}
        kdist = {i: sorted(d[i, j] for j, _ in mine if j != i)[2] for i, _ in mine}
        near = {i: [j for j, _ in mine if j != i and d[i, j] <= kdist[i]] for i, _ in mine}
        lrd = {i: 1 / max(sum(max(d[i, j], kdist[j]) for j in n) / len(n), outliers.EPSILON) for i, n in near.items()}
        assert all(got[i] == pytest.approx(sum(lrd[j] for j in n) / len(n) / lrd[i]) for i, n in near.items())


def test_outliers_sort_neighbours_natively(spark, monkeypatch):
    """array_sort calls a lambda for each comparison, so long lists of neighbours took longer to sort than to find."""
    df = spark.createDataFrame([(k, 0, f"Name#{k * k % 50:04}") for k in range(40)], "row_id long, label long, raw string")
    monkeypatch.setattr(outliers, "TILE", 4)
    want = {r.row_id: r.lof for r in outliers.lof(df).collect()}
    monkeypatch.setattr(F, "array_sort", None)
    assert {r.row_id: r.lof for r in outliers.lof(df).collect()} == want


def test_nearest_rows_sort_neighbours_natively(named, monkeypatch):
    df, dist, rows = named
    monkeypatch.setattr(F, "array_sort", None)
    assert same(graph.undirected(tiles.nearest_edges(df, "key", "name", 2)), graph.undirected(graph.directed_knn(dist, 2)))


def test_texts_of_like_prefixes(monkeypatch):
    """Texts of the left go down the tree of their prefixes, one column a prefix."""
    left, right = [b"name%03d" % k for k in range(100)] + [b"name", b"", b"name001"], [b"name%02d" % k for k in range(30)] + [b"", b"x"]
    seen = []
    rows = levenshtein._rows
    monkeypatch.setattr(levenshtein, "_rows", lambda x, at: seen.append(len(at)) or rows(x, at))
    d = levenshtein_table(left, right, True)
    assert all(d[i, j] == edit_distance(x, y) for i, x in enumerate(left) for j, y in enumerate(right))
    assert sum(seen) < 700  # two columns a prefix and the results, not seven columns a text


def test_components_end_in_one_task(spark, monkeypatch):
    """What is left of at most STAR_EDGES edges needs no rounds; more of them go on by stars."""
    pairs = [(k, k + 1) for k in range(100, 160)] + [(7, 130), (3, 5), (5, 3), (9, 9)]
    edges, ids = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(k,) for k in [3, 5, 7, 9, *range(100, 161)]], "id long")
    want = {3: 3, 5: 3, 7: 7, 9: 9} | dict.fromkeys(range(100, 161), 7)
    made = []
    inner = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda x: made.append(x) or inner(x))
    assert {r.id: r.root for r in graph.component_roots(ids, edges).collect()} == want and len(made) == 2
    monkeypatch.setattr(graph, "STAR_EDGES", 3)
    assert {r.id: r.root for r in graph.component_roots(ids, edges).collect()} == want


def test_tiles_leave_a_block_as_one_row(named, monkeypatch):
    """A worker sends a state a tile and block, not a row a text and pair of tiles."""
    df, dist, _ = named
    monkeypatch.setattr(tiles, "block_size", lambda *_: 3)
    plan = tiles.nearest_texts(tiles.distinct_texts(df, "key", "name", 2), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 2 and "Generate" in plan
    assert same(tiles.nearest_edges(df, "key", "name"), graph.directed_knn(dist, 1))


def test_leiden_over_blocks_of_tiles(named, monkeypatch):
    df, dist, _ = named
    monkeypatch.setattr(tiles, "block_size", lambda *_: 4)
    edges = checkpointed(tiles.nearest_edges(df, "key", "name", 3))
    assert same(edges, graph.directed_knn(dist, 3))
    ids = df.select(F.col("key").alias("id"))
    assert same(graph.communities(ids, graph.undirected(edges)), graph.communities(ids, graph.knn_graph(dist, 3)))
    only = df.where("key % 4 = 0").select(F.col("key").alias("i"))
    far = {r.i: r.far for r in dist.groupBy("i").agg(F.max("d").cast("long").alias("far")).collect()}
    some = tiles.nearest_rows(df, "key", "name", 3, only).collect()
    assert {r.i: r.far for r in some} == {r.i: far[r.i] for r in only.collect()}


def test_dbscan_links_leave_tiles_as_forests(named, monkeypatch):
    """Pairs within the radius are counted and joined where they are found: what leaves is fewer links than core texts a tile, and their components are the same."""
    df, dist, _ = named
    monkeypatch.setattr(tiles, "block_size", lambda *_: 3)
    assert same(graph.dbscan_texts(df, "key", "name", 1.0, 4), graph.dbscan(dist, 1.0, 4))
    texts = tiles.distinct_texts(df, "key", "name")
    core, links, border = tiles.dense_texts(texts, 9.0, 2)
    n = texts.count()
    assert core.count() == n > 16 and border.count() == 0
    assert links.count() <= (n - 1) * texts.select("tile").distinct().count() < n * n
    assert len({r.root for r in graph.component_roots(core, links).collect()}) == 1


def lof_of(rows, k=3):
    """Factors of (id, text) rows of one cluster, by the definition."""
    d = {(i, j): edit_distance(a.encode(), b.encode()) for i, a in rows for j, b in rows}
    kdist = {i: sorted(d[i, j] for j, _ in rows if j != i)[k - 1] for i, _ in rows}
    near = {i: [j for j, _ in rows if j != i and d[i, j] <= kdist[i]] for i, _ in rows}
    lrd = {i: 1 / max(sum(max(d[i, j], kdist[j]) for j in n) / len(n), outliers.EPSILON) for i, n in near.items()}
    return {i: sum(lrd[j] for j in n) / len(n) / lrd[i] for i, n in near.items()}


def test_exclusions_over_blocks_of_tiles(spark, monkeypatch):
    """Tiles meet in blocks; the lines left out are those of the definition, and reruns agree to the bit."""
    monkeypatch.setattr(outliers, "TILE", 4)
    monkeypatch.setattr(tiles, "block_size", lambda *_: 3)
    rng = random.Random(8)
    rows = [(k, k % 2, f"N{rng.randrange(100):03}" if k % 11 else "far away " * (k % 3 + 1)) for k in range(80)]
    df = spark.createDataFrame(rows, "row_id long, label long, raw string")
    found = outliers.retained(df).collect()
    want = lof_of([(i, t) for i, b, t in rows if b == 0]) | lof_of([(i, t) for i, b, t in rows if b == 1])
    assert {r.row_id: r.lof for r in found} == {i: pytest.approx(x) for i, x in want.items()}
    assert {r.row_id for r in found if r.excluded} == {i for i, x in want.items() if x >= 1.5}
    assert sorted(found) == sorted(outliers.retained(df).collect())
    assert outliers.reduced is tiles.reduced


def test_report_counts_of_copies_over_blocks(spark, monkeypatch):
    """Lines of copies count as often as they are there, in whichever block their text is."""
    monkeypatch.setattr(outliers, "TILE", 3)
    monkeypatch.setattr(tiles, "block_size", lambda *_: 2)
    rows = [(k, 5, f"Name#{k % 9:03}" if k % 7 else f"Name#{k:03}") for k in range(60)] + [(100, 5, "something else")]
    df = spark.createDataFrame(rows, "row_id long, label long, raw string")
    want = lof_of([(i, t) for i, _, t in rows])
    counted = outliers.retained(df).groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.count_if("excluded").alias("lost")).first()
    assert (counted.members, counted.lost) == (61, sum(x >= 1.5 for x in want.values()))
    assert counted.lost > 0 and outliers.reduced is tiles.reduced
