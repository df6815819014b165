"""Exact dedup by content sort.

Sampled splitters range-partition the rows by the leading bytes of the
normalised text; an external sort inside each partition lays equal texts next
to each other; neighbours are compared in full and each run keeps its smallest
identifier.  The identifier is the last part of the range key, so a group of
copies of any size spreads over as many partitions as it needs, and the runs
that touch a partition's edge are joined afterwards by one small aggregate (at
most two rows a partition).

Defined cases: null text counts as empty; null identifiers sort last and never
win over another; if a whole group has null identifiers, keep_id is null and
its first row stays.  Of rows that share text and identifier the first stays.
An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed, partitions
from .words import column_bytes, column_ids, ids_column

#: bytes of the normalised text in the sort key; the rest is compared in full
PREFIX = 24
_RUNS = "doc_id long, part int, run int, leader long, first boolean, size long, edge boolean, text_sha256 string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("run", pa.int32()), ("leader", pa.int64()), ("first", pa.bool_()), ("size", pa.int64()), ("edge", pa.bool_()), ("text_sha256", pa.string())])


def _runs(batches):
    """Sorted rows in, one row each out, with the run of equal texts that the row is in."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    run, text, digest, held = -1, None, "", []

    def closed(edge):
        ids = np.concatenate(held)
        n = len(ids)
        for at in range(0, n, 1 << 16):
            x = ids[at : at + (1 << 16)]
            m = len(x)
            first = np.zeros(m, bool)
            first[0] = at == 0
            yield pa.RecordBatch.from_arrays(
                [ids_column(x), pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, run, np.int32)), ids_column(np.full(m, ids[0])), pa.array(first), pa.array(np.full(m, n, np.int64)), pa.array(np.full(m, edge)), pa.array([digest] * m)],
                schema=_SCHEMA,
            )

    small: list[tuple] = []

    def flush():
        ids, runs, digests = zip(*small)
        m = len(ids)
        ids = np.array(ids, np.int64)
        yield pa.RecordBatch.from_arrays(
            [ids_column(ids), pa.array(np.full(m, part, np.int32)), pa.array(np.array(runs, np.int32)), ids_column(ids), pa.array(np.ones(m, bool)), pa.array(np.ones(m, np.int64)), pa.array(np.zeros(m, bool)), pa.array(digests)], schema=_SCHEMA
        )
        small.clear()

    def over(edge):
        if run < 0:
            return
        if not edge and len(held) == 1 and len(held[0]) == 1:
            small.append((held[0][0], run, digest))
            if len(small) >= 4096:
                yield from flush()
        else:
            yield from closed(edge)

    for batch in batches:
        ids, texts = column_ids(batch.column("doc_id")), column_bytes(batch.column("norm"))
        for i, t in enumerate(texts):
            if t != text:
                yield from over(run == 0)
                run, text, held = run + 1, t, []
                digest = hashlib.sha256(t).hexdigest()
            held.append(ids[i : i + 1].copy())
    yield from over(True)
    if small:
        yield from flush()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ").alias("norm"))
    rows = rows.select("*", F.substring(F.col("norm").cast("binary"), 1, PREFIX).alias("head"), F.xxhash64("norm").alias("h"))
    nulls_last = F.col("doc_id").asc_nulls_last()
    runs = (
        rows.repartitionByRange(partitions(docs.sparkSession), "head", "h", nulls_last)
        .sortWithinPartitions("head", "h", "norm", nulls_last)
        .select("doc_id", "norm")
        .mapInArrow(_runs, _RUNS)
    )
    runs = checkpointed(runs)
    # a run at an edge may go on in the next partition: at most two such runs a partition
    ends = runs.where("edge and first").groupBy("text_sha256").agg(F.sum("size").alias("whole"), F.min(F.struct("part", "run")).alias("top"), F.min("leader").alias("least"))
    a, b = runs.alias("a"), ends.alias("b")
    joined = a.join(b, F.col("a.edge") & (F.col("a.text_sha256") == F.col("b.text_sha256")), "left")
    top = F.col("b.top").isNull() | ((F.col("b.top.part") == F.col("a.part")) & (F.col("b.top.run") == F.col("a.run")))
    return joined.select(
        F.col("a.doc_id").alias("doc_id"),
        F.when(F.col("b.top").isNull(), F.col("a.leader")).otherwise(F.col("b.least")).alias("keep_id"),
        F.coalesce(F.col("b.whole"), F.col("a.size")).alias("group_size"),
        (F.col("a.first") & top).alias("kept"),
        F.col("a.text_sha256").alias("text_sha256"),
    )
