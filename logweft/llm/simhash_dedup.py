"""SimHash near-duplicates, linked through BK-trees.

A document's fingerprint has bit b set if over half of its shingles' XXH64
hashes do.  Distinct fingerprints (not documents) go on.  The 64 bits are cut
into `blocks` blocks; two fingerprints within the radius agree on at least
blocks - radius of them, so every choice of so many blocks and their value
names a shard, each shard is a BK-tree, and a fingerprint asks the trees of its
own shards only, along the edges within the radius.  With more blocks a choice
has more bits: the number of blocks follows the number of fingerprints, so that
shards stay small while the corpus grows, and a pair is found whatever it is.
Trees grow with the corpus, so they are dealt out with their queries rather
than broadcast.  A shard hands on not its pairs but each point's link to the
smallest of its local component, and components over those links are found by
alternating stars.  Names of components go back to fingerprints and documents
by joins; of the keys that hold a thousandth of all rows or more, which are a
thousand at most, the names are broadcast.

Defined cases: null, empty and white-space texts have fingerprint zero and are
linked like any other; a null identifier is never a component's smallest, and a
component of null identifiers has a null one; repeated identifiers each get a
row; an empty table gives an empty result.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import Trees, union_labels
from .components import components
from .session import checkpointed
from .words import column_bytes, sliced

SEED = 42
#: what a fingerprint's copy costs to move, in points of a tree
COPY = 64
#: keys with one in so many of all rows are hot
HOT = 1000
#: hashes turned into bits at once
CHUNK = 1 << 16


def _bit_counts(h: np.ndarray) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        bits = np.unpackbits(h[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.int64)
    return total


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of one text (UTF-8), bit 63 the highest of XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist())), np.uint64, len(words) - shingle + 1)
    bits = 2 * _bit_counts(h) > len(h)
    return int(np.packbits(bits).view(">u8")[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in sliced(batches, 1):
            out = np.array([fingerprint(t, shingle) for t in column_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp's 64 bits as a long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _blocks(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of blocks that cover 64 bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def choices(blocks: int, radius: int) -> list[list[tuple[int, int]]]:
    """All choices of blocks on which two fingerprints within the radius may agree."""
    return [list(c) for c in combinations(_blocks(blocks), blocks - radius)]


def best_blocks(n: int, radius: int, most: int = 4) -> int:
    """Number of blocks for n fingerprints: the least work, copies times (what a copy costs + its neighbours in a shard)."""

    def work(blocks):
        chosen = choices(blocks, radius)
        return len(chosen) * (COPY + n / 2 ** min(sum(w for _, w in c) for c in chosen))

    return min(range(radius + 1, min(64, radius + most) + 1), key=work)


def _stars(radius: int):
    """Rows (shard, fp) of whole shards -> (u, v): each linked fp to the smallest of its local component."""

    def run(batches):
        for batch in batches:
            shard, fp = (np.asarray(batch.column(k)) for k in (0, 1))
            if not len(fp):
                continue
            # smallest first, as signed longs like the rest of Spark orders them
            order = np.lexsort((fp, shard))
            shard, fp = shard[order], fp[order]
            label = union_labels(len(fp), Trees(shard, fp.view(np.uint64)).links(radius))
            linked = label != np.arange(len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], names=["u", "v"])

    return run


def _whole_shards(batches):
    """Batches of rows sorted by shard, cut again so that no shard is in two."""
    held = []
    for batch in batches:
        shard = np.asarray(batch.column(0))
        if not len(shard):
            continue
        cut = int(np.searchsorted(shard, shard[-1]))
        if cut or held and np.asarray(held[-1].column(0))[-1] != shard[-1]:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if sum(map(len, held)) else held[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def links(fps: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """(u, v): stars over distinct fingerprints fps(fp) whose components are those of all links."""
    blocks = best_blocks(fps.count(), radius) if blocks is None else blocks
    value = lambda a, w: F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1))
    # equal hashes of unlike choices only put more points into a tree
    shards = F.array(*[F.xxhash64(F.lit(k), *[value(a, w) for a, w in c]) for k, c in enumerate(choices(blocks, radius))])
    rows = fps.select(F.explode(shards).alias("shard"), "fp")
    star = _stars(radius)
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda batches: star(_whole_shards(batches)), "u long, v long")


def named(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """rows joined with names (key, ..., rows_: number of rows that have the key); names of keys with a thousandth of all rows are broadcast."""
    total = names.agg(F.sum("rows_")).first()[0] or 0
    hot = names.where(F.col("rows_") * HOT >= total).drop("rows_")  # HOT rows at most
    rest = names.where(F.col("rows_") * HOT < total).drop("rows_")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def _named(fp: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id, rows_): each distinct fingerprint's component, by its root and by its smallest identifier, and the fingerprint's rows."""
    distinct = checkpointed(fp.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct, radius))
    rooted = checkpointed(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows_")))
    return checkpointed(named(rooted, ids, "root").select("fp", "root", "component_id", F.col("n").alias("rows_")))


def smallest_rows(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups): identifiers that are the smallest of a component; groups maps the XXH64 of such a row's text (null as empty) to the component's root."""
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"))
    fp = checkpointed(rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long, h long"))
    least = named(fp, _named(fp, radius), "fp").where("doc_id = component_id").select("doc_id", "h", "root").distinct()
    return least.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("h", "root"))).alias("groups"))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest identifier reachable over links of at most radius bits)."""
    fp = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    names = _named(fp, radius).select("fp", "component_id", "rows_")
    return named(fp, names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
