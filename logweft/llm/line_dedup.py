"""Line dedup by probing a sharded minimal perfect hash.

Each task first reduces its documents' lines to distinct pairs of a 128-bit hash
and an identifier; an aggregate over the pairs and one over the hashes give the
lines found in enough documents, whatever tasks the rows of a document are
dealt to.  They go, by the range of their hash, into
shards; a shard is a minimal perfect hash with compact fingerprint, count and
last-holder arrays.  Documents then probe the arrays; their lines are never
joined.  The arrays are broadcast while their measured size in memory is at most
`broadcast_bytes`; above, blocks of documents send their line hashes to the
shards and get one bit a line back.  A shard's questions are dealt into groups
of measured size, each of which meets a copy of the shard's arrays.

Defined cases: null or empty text is one empty line; a null identifier is the
largest of all, and a line with several null-identified holders stays in all of
them; rows that share an identifier count as one document.  An empty table
gives an empty result.
"""
from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import MESSAGE, blocks, expand, pack_texts, receive, squeeze, unpack_texts
from .mphf import LineIndex
from .session import checkpointed
from .words import NO_ID, column_bytes, column_ids, ids_column, release, sliced

STRIP = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
BROADCAST_BYTES = 64 << 20
#: lines a shard is made for, about
SHARD_LINES = 1 << 20
#: bytes of questions that meet a shard at once, about
GROUP_BYTES = 64 << 20


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line's key, or None if it is too short to count."""
    key = line.strip(STRIP)
    if len(key) < min_chars or len(key) < 4 * min_chars and sum((c & 0xC0) != 0x80 for c in key) < min_chars:
        return None
    return key.translate(_UPPER)


def line_hashes(lines: list[bytes], min_chars: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(places of lines that count, first and second half of their hashes)."""
    at, digests = [], []
    for i, line in enumerate(lines):
        if (key := line_key(line, min_chars)) is not None:
            at.append(i)
            digests.append(xxhash.xxh3_128_digest(key))
    halves = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    return at, halves[:, 0], halves[:, 1]


_COUNTED = pa.schema([("k", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("n", pa.int64())])


def _counted(min_chars: int):
    """Distinct (line, identifier) of some thousand documents; n counts the documents of a null identifier, which is NO_ID."""

    def reduce(k, c, d):
        order = np.lexsort((d, c, k))
        k, c, d = k[order], c[order], d[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        n = np.where(d[at] == NO_ID, np.diff(np.append(at, len(k))), 1)
        return pa.RecordBatch.from_arrays([pa.array(k[at].view(np.int64)), pa.array(c[at].view(np.int64)), pa.array(d[at]), pa.array(n)], schema=_COUNTED)

    def run(batches):
        ks, cs, ds, held = [], [], [], 0
        for batch in sliced(batches, 1):
            for d, t in zip(column_ids(batch.column(0)).tolist(), column_bytes(batch.column(1))):
                _, k, c = line_hashes(t.split(b"\n"), min_chars)
                if d == NO_ID:  # a document of its own, which counts a line once
                    k, c = np.unique(np.stack([k, c]), axis=1)
                if len(k):
                    ks.append(k)
                    cs.append(c)
                    ds.append(np.full(len(k), d))
                    held += len(k)
            if held > 1 << 19:
                yield reduce(np.concatenate(ks), np.concatenate(cs), np.concatenate(ds))
                ks, cs, ds, held = [], [], [], 0
        if held:
            yield reduce(np.concatenate(ks), np.concatenate(cs), np.concatenate(ds))
        release()

    return run


def frequent_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(k, c, n, last): hash halves, documents and largest holder of the lines found in enough documents.

    Rows that share an identifier count once; those without one count each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(min_chars), "k long, c long, d long, n long")
    holders = rows.groupBy("k", "c", "d").agg(F.when(F.col("d") == NO_ID, F.sum("n")).otherwise(1).alias("n"))
    return holders.groupBy("k", "c").agg(F.sum("n").alias("n"), F.max("d").alias("last")).where(F.col("n") >= min_docs)


def line_index(lines: DataFrame, shards: int) -> DataFrame:
    """(shard, payload, size): each shard's LineIndex, and its bytes in memory."""
    shard = F.pmod(F.shiftrightunsigned("k", 33), F.lit(shards)).cast("int").alias("shard")

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        k, c, n, last = (table.column(x).to_numpy() for x in ("k", "c", "n", "last"))
        index = LineIndex(k.view(np.uint64), c.view(np.uint64), n, last)
        data = pickle.dumps(index)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "payload": pa.array([squeeze(data)], pa.binary()), "size": pa.array([len(data)], pa.int64())})

    return lines.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard int, payload binary, size long")


def _shard_of(k: np.ndarray, shards: int) -> np.ndarray:
    return (k >> np.uint64(33)) % np.uint64(shards)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.binary())])


def _kept(ids: np.ndarray, texts: list[bytes], dropped) -> pa.RecordBatch:
    """dropped(ids per line, k, c) -> boolean per line that counts."""
    split = [t.split(b"\n") for t in texts]
    places, ks, cs = [], [], []
    for lines, min_chars in ((x, dropped.min_chars) for x in split):
        at, k, c = line_hashes(lines, min_chars)
        places.append(at)
        ks.append(k)
        cs.append(c)
    sizes = [len(x) for x in places]
    k, c = np.concatenate([np.zeros(0, np.uint64), *ks]), np.concatenate([np.zeros(0, np.uint64), *cs])
    gone = dropped(np.repeat(ids, sizes), k, c)
    out, n, at = [], [], 0
    for lines, place, t, size in zip(split, places, texts, sizes):
        mine = gone[at : at + size]
        at += size
        if not mine.any():
            out.append(t)
            n.append(0)
            continue
        drop = {p for p, g in zip(place, mine.tolist()) if g}
        out.append(b"\n".join(x for i, x in enumerate(lines) if i not in drop))
        n.append(len(drop))
    return pa.RecordBatch.from_arrays([ids_column(ids), pa.array([len(x) for x in split], pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], schema=_RESULT)


class _Probe:
    def __init__(self, indexes: dict[int, bytes], shards: int, min_chars: int):
        self.indexes, self.shards, self.min_chars = {s: pickle.loads(expand(p)) for s, p in indexes.items()}, shards, min_chars

    def __call__(self, ids, k, c):
        gone, shard = np.zeros(len(k), bool), _shard_of(k, self.shards)
        for s in np.unique(shard).tolist() if len(k) else ():
            if s in self.indexes:
                mine = np.flatnonzero(shard == s)
                found, last = self.indexes[s].probe(k[mine], c[mine])
                gone[mine] = found & (ids[mine] != last)
        return gone


class _Answers:
    """Answers that came back from the shards, in the order in which the block sent its lines."""

    def __init__(self, bits: dict[int, np.ndarray], shards: int, min_chars: int):
        self.bits, self.shards, self.min_chars = bits, shards, min_chars

    def __call__(self, ids, k, c):
        gone, shard = np.zeros(len(k), bool), _shard_of(k, self.shards)
        for s, bits in self.bits.items():
            mine = np.flatnonzero(shard == s)
            gone[mine] = bits[: len(mine)]
        return gone


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept (the remaining text, UTF-8 bytes), and the columns of keep."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = checkpointed(frequent_lines(plain, min_chars, min_docs))
    shards = max(1, -(-lines.count() // SHARD_LINES))
    index = checkpointed(line_index(lines, shards))
    size = index.agg(F.sum("size")).first()[0] or 0
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast({r.shard: bytes(r.payload) for r in index.select("shard", "payload").collect()})

        def probe(batches):
            p = _Probe(held.value, shards, min_chars)
            for batch in sliced(batches, 1):
                got = _kept(column_ids(batch.column(0)), column_bytes(batch.column(1)), p)
                yield pa.RecordBatch.from_arrays([*got.columns, *batch.columns[2:]], names=[*got.schema.names, *batch.schema.names[2:]])

        carried = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_{c}") for c in keep])
        types = ", ".join(f"`_{c}` {t}" for c, t in docs.select(*keep).dtypes) if keep else ""
        out = carried.mapInArrow(probe, "doc_id long, n_lines long, n_dropped long, kept binary" + (", " + types if types else ""))
        return out.select("doc_id", "n_lines", "n_dropped", "kept", *[F.col(f"_{c}").alias(c) for c in keep])
    out = _exchanged(plain, index, shards, min_chars)
    if not keep:
        return out.drop("before")
    # rows alike in identifier and text have like results, so one of each is joined back
    out = out.withColumn("h", F.xxhash64("before")).dropDuplicates(["doc_id", "h"])
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("j"), *[F.col(c).alias(f"_{c}") for c in keep])
    joined = rows.join(out, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("j") == F.col("h")))
    return joined.select("doc_id", "n_lines", "n_dropped", "kept", *[F.col(f"_{c}").alias(c) for c in keep])


def _exchanged(plain: DataFrame, index: DataFrame, shards: int, min_chars: int) -> DataFrame:
    def send(block, kind, ids, texts):
        yield -1, pack_texts(ids, texts)
        ks, cs, n = [], [], []
        for t in texts:
            _, k, c = line_hashes(t.split(b"\n"), min_chars)
            ks.append(k)
            cs.append(c)
            n.append(len(k))
        k, c, owner = np.concatenate(ks), np.concatenate(cs), np.repeat(ids, n)
        shard = _shard_of(k, shards)
        for s in np.unique(shard).tolist():
            mine = shard == s
            yield int(s), pickle.dumps((owner[mine], k[mine], c[mine]))

    sent = checkpointed(blocks(plain, send))

    def answer(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        s, out = key[0].as_py(), []
        stored = right.column("payload").to_pylist()
        probe = _Probe({0: stored[0]}, 1, min_chars) if stored else None
        for b, p in zip(left.column("block").to_pylist(), left.column("payload").to_pylist()):
            ids, k, c = pickle.loads(p)
            out.append((b, s, np.packbits(probe(ids, k, c)).tobytes() if probe else bytes(len(k) + 7 >> 3)))
        b, s, p = zip(*out) if out else ((), (), ())
        return pa.table({"block": pa.array(b, pa.int64()), "shard": pa.array(s, pa.int32()), "payload": pa.array(p, pa.binary())})

    asked = sent.where("shard >= 0")
    most = asked.groupBy("shard").agg(F.sum(F.length("payload")).alias("n")).agg(F.max("n")).first()[0] or 0
    groups = max(1, -(-most // GROUP_BYTES))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    copies = index.select("shard", "payload", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    replies = asked.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(answer, MESSAGE)

    def take(block, payload, got):
        ids, texts = unpack_texts(payload)
        bits = {s: np.unpackbits(np.frombuffer(p, np.uint8)).astype(bool) for s, p in got.items()}
        got = pa.Table.from_batches([_kept(ids, texts, _Answers(bits, shards, min_chars))])
        return got.append_column("before", pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string()))

    return receive(sent.where("shard < 0"), replies, take, "doc_id long, n_lines long, n_dropped long, kept binary, before string")
