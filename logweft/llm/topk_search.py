"""Exact top-k search by inner product with ball trees.

Rows are dealt by a hash of their identifier into runs, each the rows of one
task, and packed into messages on the way, so every row moves once.  Queries
are packed into blocks, which go to every run.  A task reads its run's rows,
builds their ball trees (SHARD_ROWS points each) and then takes the blocks one
after another: a block meets each tree by branch and bound, the k-th scores
found so far pruning the next tree.  Before that, each query gets a first k-th
score from a bounded sample of rows, so all tasks prune from the start.  The
last step merges the best k of each query and run.

The queries are a stated set (every 20th identifier, say) and meet all rows in
blocks; the work is their product by nature, less what the bounds save.  A run
is as many rows as fill the cores, at most RUN_BYTES of them.

Defined cases: vectors that are null, or hold a null or a non-finite component,
take no part, nor does a row whose identifier is null; a shorter vector counts
as followed by zeros; components are exact integers of any size, and a score
beyond the range of long counts as the range's end; rows with the query's own
identifier are no candidates; rows that share an identifier are candidates and
queries of their own; fewer candidates than k give fewer rows; no
queries or an empty table give an empty result.
"""
from __future__ import annotations

import math
import pickle
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .balltree import BallTree, TopK, products, search, small
from .session import partitions
from .words import release

SHARD_ROWS, QUERY_ROWS = 8192, 1024
#: of vectors: a run's at most, a message's about, and a run's at least in rows
RUN_BYTES, MESSAGE_BYTES, RUN_ROWS = 64 << 20, 1 << 20, 1024
#: rows from which the first k-th scores come
SAMPLE_ROWS = 2048
_OUT = pa.schema([("query_id", pa.int64()), ("tag", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_PACKED = pa.schema([("run", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def finite(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x array<double>): the vectors that take part."""
    x = F.col("x")
    ok = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.where(ok & F.col("vec_id").isNotNull())


def exact(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python's integers."""
    return np.array([[math.floor(Fraction(e) * scale) for e in row] for row in x.tolist()], object).reshape(x.shape)


def _by_length(batch: pa.RecordBatch, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places in a batch, quantised vectors) for each length of vectors; floats, and Python's integers for vectors that are beyond floats."""
    lists = batch.column(1)
    start = np.asarray(lists.offsets)
    size, flat = np.diff(start), np.asarray(lists.values)
    out = []
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        x = flat[start[at][:, None] + np.arange(n)].astype(np.float64).reshape(len(at), n)
        with np.errstate(over="ignore"):
            v = np.floor(x * float(scale))
        fits = np.isfinite(v).all(1)
        if fits.any():
            out.append((at[fits], v[fits]))
        if not fits.all():
            out.append((at[~fits], exact(x[~fits], scale)))
    return out


def _pairs(batch: pa.RecordBatch, scale: int):
    ids = np.asarray(batch.column(0))
    return [(ids[at], v) for at, v in _by_length(batch, scale)]


def fitted(vectors: np.ndarray, n: int) -> np.ndarray:
    """Vectors cut or filled with zeros to n components."""
    if vectors.shape[1] >= n:
        return vectors[:, :n]
    return np.concatenate([vectors, np.zeros((len(vectors), n - vectors.shape[1]), vectors.dtype)], 1)


class Shard:
    """Points of one length: ball trees of those whose products fit 64 bits, and the others as they are."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        fits = small(vectors) if vectors.dtype != object else np.zeros(len(ids), bool)
        order = np.flatnonzero(fits)
        self.width = vectors.shape[1]
        self.trees = [BallTree(ids[order[a : a + SHARD_ROWS]], vectors[order[a : a + SHARD_ROWS]]) for a in range(0, len(order), SHARD_ROWS)]
        self.ids, self.vectors = ids[~fits], vectors[~fits]

    def visit(self, queries: np.ndarray, rows: np.ndarray, top: TopK):
        q = fitted(queries, self.width)
        fits = small(q) if q.dtype != object else np.zeros(len(q), bool)
        for tree in self.trees:
            search(tree, q[fits].astype(np.float64), top, rows[fits])
            for i in np.flatnonzero(~fits):
                top.add(rows[i : i + 1], tree.ids, products(q[i : i + 1], tree.vectors))
        for a in range(0, len(self.ids), 256):
            top.add(rows, self.ids[a : a + 256], products(q, self.vectors[a : a + 256]))


def _pieces(ids: np.ndarray, vectors: np.ndarray, most: int):
    step = max(1, min(most, MESSAGE_BYTES // (8 * vectors.shape[1] + 8)))
    for a in range(0, len(ids), step):
        yield ids[a : a + step], vectors[a : a + step]


def _rows_of(runs: int, scale: int):
    """Rows as messages to their runs."""
    from .words import mix

    def run(batches):
        for batch in batches:
            found = []
            for ids, x in _pairs(batch, scale):
                to = (mix(ids.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(runs)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(runs + 1))
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    mine = order[edges[k] : edges[k + 1]]
                    found += [(k, 0, pickle.dumps(p)) for p in _pieces(ids[mine], x[mine], 1 << 30)]
            yield _message(found)

    return run


def _message(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else ((), (), ()), _PACKED.types)], schema=_PACKED)


def _queries_of(sample, k: int, scale: int):
    """Queries as blocks, each with a score that k rows of the sample reach."""

    def run(batches):
        held = [Shard(*x) for batch in pickle.loads(sample.value) for x in _pairs(batch, scale)]
        for batch in batches:
            found = []
            ids, tags = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for at, x in _by_length(batch, scale):
                for a, q in _pieces(at, x, QUERY_ROWS):
                    i = ids[a]
                    top = TopK(i, k)
                    for shard in held:
                        shard.visit(q, np.arange(len(i)), top)
                    top.cut()
                    found.append((0, 1, pickle.dumps((i, tags[a], q, top.kth))))
            yield _message(found)

    return run


def _find(k: int):
    """Sorted messages: a run's rows, then the blocks of queries."""

    def run(batches):
        at, parts, shards = None, [], None
        for batch in batches:
            for to, kind, payload in zip(*[c.to_pylist() for c in batch.columns]):
                if to != at:
                    at, parts, shards = to, [], None
                if kind == 0:
                    parts.append(pickle.loads(payload))
                    continue
                if shards is None:
                    kind_of = lambda p: (p[1].shape[1], p[1].dtype == object)
                    shards = [Shard(*(np.concatenate(c) for c in zip(*[p for p in parts if kind_of(p) == w]))) for w in sorted({*map(kind_of, parts)})]
                    parts = []
                ids, tags, q, floor = pickle.loads(payload)
                top = TopK(ids, k, floor)
                for shard in shards:
                    shard.visit(q, np.arange(len(ids)), top)
                top.cut()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[top.row], tags[top.row], top.id, top.score)], schema=_OUT)
        release()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query its k best other rows: query_id, rank (from 1), vec_id, score.  is_query is a condition on the column vec_id."""
    spark = vectors.sparkSession
    rows = finite(vectors, id_col, vector_col)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.sum(F.size("x")).alias("d")).first()
    if not facts.q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    runs = max(1, -(-8 * (facts.d or 0) // RUN_BYTES), min(partitions(spark), facts.n // RUN_ROWS))
    spot = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    drawn = rows.orderBy(spot, "vec_id").limit(SAMPLE_ROWS).toArrow().combine_chunks().to_batches()
    sample = spark.sparkContext.broadcast(pickle.dumps(drawn))
    kinds = "run int, kind int, payload binary"
    blocks = rows.where(is_query).withColumn("tag", F.monotonically_increasing_id()).mapInArrow(_queries_of(sample, k, scale), kinds)
    blocks = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "kind", "payload")
    sent = rows.mapInArrow(_rows_of(runs, scale), kinds).union(blocks)
    dealt = sent.repartitionById(runs, F.col("run")).sortWithinPartitions("run", "kind")
    found = dealt.mapInArrow(_find(k), "query_id long, tag long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
