"""Alignment of token lines: maximal runs of equal tokens along diagonals, and their best chain."""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import spread

PATH = "array<struct<b_start:int,r_start:int,len:int>>"


def _segments(threshold: int):
    def run(batches):
        for batch in batches:
            labels, refs, base, other = batch.columns
            found = [runs_of(x, y, threshold) for x, y in zip(base.to_pylist(), other.to_pylist())]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            flat = np.array([r for x in found for r in x], np.int32).reshape(-1, 3)
            pick = pa.array(at)
            yield pa.RecordBatch.from_arrays([labels.take(pick), refs.take(pick), *[pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)]], names=["label", "ref_id", "b_start", "r_start", "len"])

    return run


def diagonal_segments(base: DataFrame, refs: DataFrame, threshold: int = 1) -> DataFrame:
    """base (label, tokens), refs (label, ref_id, tokens) -> (label, ref_id, b_start, r_start, len): all maximal diagonal runs of at least `threshold` tokens.

    A reference meets its label's base once and its runs are found there: cells
    are neither joined nor moved.
    """
    met = refs.select("label", "ref_id", "tokens").join(base.select("label", F.col("tokens").alias("base_tokens")), "label").select("label", "ref_id", "base_tokens", "tokens")
    kinds = dict(met.dtypes)
    return spread(met).mapInArrow(_segments(threshold), f"label {kinds['label']}, ref_id {kinds['ref_id']}, b_start int, r_start int, len int")


def common_runs(members: DataFrame, k: int, threshold: int = 1) -> DataFrame:
    """members (label, local 0 .. k - 1, tokens) -> (label, start array<int>, len): maximal runs of tokens that all k members of a label have along a diagonal of their grid.

    One equi-join on (label, token) a member finds the cells, and the first
    coordinate less row numbers along a diagonal the islands.
    """
    at = lambda n: members.where(F.col("local") == n).select("label", F.posexplode("tokens").alias(f"p{n}", "t"))
    cells = at(0)
    for n in range(1, k):
        cells = cells.join(at(n), ["label", "t"])
    places = [F.col(f"p{n}") for n in range(k)]
    cells = cells.select("label", F.array(*places).alias("place"), F.col("p0"), F.array(*[p - places[0] for p in places]).alias("diag"))
    run = F.col("p0") - F.row_number().over(Window.partitionBy("label", "diag").orderBy("p0"))
    runs = cells.withColumn("run", run).groupBy("label", "diag", "run").agg(F.min_by("place", "p0").alias("start"), F.count(F.lit(1)).cast("int").alias("len"))
    return runs.where(F.col("len") >= threshold).select("label", "start", "len")


def chain_graph(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """(label, ref_id, src, dst, weight): which run may follow which, and at what cost.

    segments (label, ref_id, b_start, r_start, len), sizes (label, ref_id, n,
    m).  Vertices are named by their starts, S and T stand for the start and
    the end.  A chain begins at both sequences' starts or inside both, ends
    likewise, and leaves a token out on both sides between two runs; weights
    count tokens left out less tokens matched.
    """
    x = segments.join(sizes, ["label", "ref_id"]).select(
        "label", "ref_id", "b_start", "r_start", "len", "n", "m", F.concat_ws(",", "b_start", "r_start").alias("name"), (F.col("b_start") + F.col("len") - 1).alias("b_end"), (F.col("r_start") + F.col("len") - 1).alias("r_end")
    )
    begins = x.where("b_start = 0 AND r_start = 0 OR b_start > 0 AND r_start > 0").select("label", "ref_id", F.lit("S").alias("src"), F.col("name").alias("dst"), (F.col("b_start") + F.col("r_start") - F.col("len")).alias("weight"))
    ends = x.where("(b_end = n - 1) = (r_end = m - 1)").select("label", "ref_id", F.col("name").alias("src"), F.lit("T").alias("dst"), (F.col("n") - F.col("b_end") + F.col("m") - F.col("r_end") - 1).alias("weight"))
    p, q = x.alias("p"), x.alias("q")
    hop_b, hop_r = F.col("q.b_start") - F.col("p.b_end"), F.col("q.r_start") - F.col("p.r_end")
    hops = p.join(q, (F.col("p.label") == F.col("q.label")) & (F.col("p.ref_id") == F.col("q.ref_id")) & (hop_b >= 2) & (hop_r >= 2))
    hops = hops.select("p.label", "p.ref_id", F.col("p.name").alias("src"), F.col("q.name").alias("dst"), (hop_b + hop_r - F.col("q.len")).alias("weight"))
    return begins.unionByName(hops).unionByName(ends)


def runs_of(base: list, ref: list, threshold: int = 1) -> list[tuple[int, int, int]]:
    """The same runs of two sequences, in lexicographic order."""
    where: dict = {}
    for j, t in enumerate(ref):
        where.setdefault(t, []).append(j)
    open_: dict[int, int] = {}
    out = []
    for i, t in enumerate(base):
        now = {}
        for j in where.get(t, ()):
            now[j - i] = open_.get(j - i, 0) + 1
        for d in open_.keys() - now.keys():
            out.append((i - open_[d], i - open_[d] + d, open_[d]))
        # a diagonal that leaves the reference ends here as well
        for d in [d for d in now if i + 1 + d >= len(ref)]:
            out.append((i + 1 - now[d], i + 1 - now[d] + d, now[d]))
            del now[d]
        open_ = now
    out += [(len(base) - n, len(base) - n + d, n) for d, n in open_.items()]
    return sorted(x for x in out if x[2] >= threshold)


def best_chain(runs: list[tuple[int, int, int]], n: int, m: int) -> list[tuple[int, int, int]]:
    """The cheapest chain of runs (sorted by start) from the start to the end of sequences of n and m tokens.

    A chain may begin at (0, 0) or inside both sequences and end likewise;
    chained runs leave at least one token out on both sides; cost counts tokens
    left out less tokens matched.  Ties go to the start, then to the first run.
    One single run is taken whatever its place; if no chain reaches the end the
    result is empty.
    """
    if len(runs) == 1:
        return runs
    cost: list[float] = []
    came: list[int | None] = []
    for k, (b, r, size) in enumerate(runs):
        best, prev = (b + r - size, None) if (b == 0 and r == 0) or (b > 0 and r > 0) else (float("inf"), None)
        for p in range(k):
            pb, pr, ps = runs[p]
            hop_b, hop_r = b - (pb + ps - 1), r - (pr + ps - 1)
            if hop_b >= 2 and hop_r >= 2 and cost[p] + hop_b + hop_r - size < best:
                best, prev = cost[p] + hop_b + hop_r - size, p
        cost.append(best)
        came.append(prev)
    end, last = float("inf"), None
    for k, (b, r, size) in enumerate(runs):
        eb, er = b + size - 1, r + size - 1
        if (eb == n - 1) == (er == m - 1) and (eb, er) <= (n - 1, m - 1):
            total = cost[k] + (n - eb) + (m - er) - 1
            if total < end:
                end, last = total, k
    out = []
    while last is not None:
        out.append(runs[last])
        last = came[last]
    return out[::-1]


@lru_cache(1 << 14)
def _chain_of(runs: tuple, n: int, m: int) -> list[tuple[int, int, int]]:
    return best_chain(list(runs), n, m)


def align(base: list, ref: list, threshold: int = 1) -> list[tuple[int, int, int]]:
    """The best chain of two sequences; lines of one shape mostly have the same runs, so chains are kept."""
    return _chain_of(tuple(runs_of(base, ref, threshold)), len(base), len(ref))


def _chains(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([[{"b_start": b, "r_start": r, "len": n} for b, r, n in align(list(x), list(y))] for x, y in zip(base, ref)])


def chain(base, ref) -> Column:
    """Best chain of two token columns."""
    return F.pandas_udf(_chains, PATH)(base, ref)


def base_paths(members: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """members (label, local, row_id, tokens) -> (label, base_id, ref_id, path): every other member against the label's local 0.

    Paths that are known already (base_id, ref_id, path) are taken as they are.
    """
    base = members.where("local = 0").select("label", F.col("row_id").alias("base_id"), F.col("tokens").alias("base_tokens"))
    refs = members.where("local > 0").join(base, "label").withColumnRenamed("row_id", "ref_id")
    fresh = lambda r: spread(r).select("label", "base_id", "ref_id", chain("base_tokens", "tokens").alias("path"))
    if known is None:
        return fresh(refs)
    pairs = known.select("base_id", "ref_id", "path")
    old = refs.join(pairs, ["base_id", "ref_id"]).select("label", "base_id", "ref_id", "path")
    return old.unionByName(fresh(refs.join(pairs, ["base_id", "ref_id"], "left_anti")))


def all_pairs_paths(members: DataFrame) -> DataFrame:
    """(label, base_id, ref_id, path) for all ordered pairs of different members of a label: a quadratic operator for small labels."""
    other = members.select("label", F.col("row_id").alias("ref_id"), F.col("tokens").alias("ref_tokens"))
    return members.join(other, "label").where("row_id <> ref_id").select("label", F.col("row_id").alias("base_id"), "ref_id", chain("tokens", "ref_tokens").alias("path"))


def target_paths(members: DataFrame, target: int) -> DataFrame:
    """(label, base_id, ref_id, path): every member against one, which is the reference."""
    ref = members.where(F.col("row_id") == target).select("label", F.col("row_id").alias("ref_id"), F.col("tokens").alias("ref_tokens"))
    return members.where(F.col("row_id") != target).join(ref, "label").select("label", F.col("row_id").alias("base_id"), "ref_id", chain("tokens", "ref_tokens").alias("path"))


def matched(path) -> Column:
    """Matched tokens of a path."""
    return F.aggregate(path, F.lit(0), lambda a, s: a + s["len"])


def path_text(tokens_, path) -> Column:
    """Texts of a path's base segments."""
    return F.transform(path, lambda s: F.array_join(F.slice(tokens_, s["b_start"] + 1, s["len"]), ""))


def largest_segment(path) -> Column:
    """The longest segment; of equals the first."""
    return F.aggregate(path, F.lit(None).cast("struct<b_start:int,r_start:int,len:int>"), lambda a, s: F.when(a.isNull() | (s["len"] > a["len"]), s).otherwise(a))


def character_alignment_distance(rows: DataFrame) -> DataFrame:
    """rows (label, row_id, raw): (i, j, d), d = length of i less the L2 norm of the lengths of its matched runs with j, less the row's smallest positive such value."""
    chars = rows.select("label", "row_id", F.filter(F.split("raw", ""), lambda c: c != "").alias("tokens"))
    paths = all_pairs_paths(chars).join(rows.select(F.col("row_id").alias("base_id"), F.length("raw").alias("n")), "base_id")
    norm = F.sqrt(F.aggregate("path", F.lit(0.0), lambda a, s: a + s["len"] * s["len"]))
    d = paths.select(F.col("base_id").alias("i"), F.col("ref_id").alias("j"), (F.col("n") - norm).alias("d"))
    low = F.min(F.when(F.col("d") > 0, F.col("d"))).over(Window.partitionBy("i"))
    return d.withColumn("low", F.coalesce(low, F.lit(0.0))).select("i", "j", F.greatest(F.col("d") - F.col("low"), F.lit(0.0)).alias("d"))


def segment_cooccurrence(members: DataFrame, paths: DataFrame) -> DataFrame:
    """(text, next_text, n): how often one matched segment follows another over all paths of two segments or more; S and T stand for start and end."""
    x = paths.where(F.size("path") > 1).join(members.select("label", F.col("row_id").alias("base_id"), "tokens"), ["label", "base_id"])
    steps = F.concat(F.array(F.lit("S")), path_text("tokens", F.col("path")), F.array(F.lit("T")))
    pairs = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(F.element_at("s", i).alias("text"), F.element_at("s", i + 1).alias("next_text")))
    return x.select(steps.alias("s")).select(F.explode(pairs).alias("p")).groupBy("p.text", "p.next_text").agg(F.count(F.lit(1)).alias("n"))


def unanimous(members: DataFrame) -> DataFrame:
    """(label, pos, n_distinct, token): distinct tokens at each place of all members; token where they agree."""
    total = members.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    at = members.select("label", F.posexplode("tokens").alias("pos", "token")).groupBy("label", "pos").agg(F.count_distinct("token").alias("n_distinct"), F.min("token").alias("token"), F.count(F.lit(1)).alias("n"))
    return at.join(total, "label").select("label", "pos", "n_distinct", F.when((F.col("n_distinct") == 1) & (F.col("n") == F.col("members")), F.col("token")).alias("token"))
