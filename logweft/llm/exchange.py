"""Blocks and shards: how whole corpora ask hash-sharded statistics for answers.

Documents are dealt into blocks of some megabytes of text.  A block sends each
shard one compact message about the keys it needs (sorted, distinct, packed),
a shard answers each message in the message's order, and the block, together
with its own texts, takes the answers in.  What crosses the network are the
distinct keys of each block, a few bytes each, instead of a row for each word;
a key that is frequent anywhere costs one entry a block, so no key is hot.
"""
from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import column_bytes, column_ids, release, sliced

MESSAGE = "block long, shard int, payload binary"
_MESSAGE = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary())])
#: bytes of text in a block, about
BLOCK_BYTES = 6 << 20


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.compress(data, level)


def expand(data: bytes) -> bytes:
    return zstandard.decompress(data)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as differences in byte planes, so that their high bytes cost nothing."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return squeeze(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Any integers, in byte planes."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize
    return values.dtype.str.encode().ljust(4) + squeeze(values.view(np.uint8).reshape(-1, width).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:4].decode().strip())
    planes = np.frombuffer(expand(data[4:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_texts(ids: np.ndarray, texts: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return pickle.dumps((ids.tobytes(), sizes.tobytes(), squeeze(b"".join(texts), 3)))


def unpack_texts(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    ids, sizes, body = pickle.loads(data)
    body, at = expand(body), np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))]).tolist()
    return np.frombuffer(ids, np.int64), [body[a:b] for a, b in zip(at, at[1:])]


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, bounds) of sorted keys: a shard is a range of the 64-bit key space."""
    edges = (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64) if shards > 1 else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    for s in range(shards):
        if at[s] < at[s + 1]:
            yield s, slice(int(at[s]), int(at[s + 1]))


def blocks(docs: DataFrame, send: Callable[[int, int, np.ndarray, list[bytes]], Iterator[tuple[int, bytes]]], id_col: str = "doc_id", text_col: str = "text", kind: Callable[[np.ndarray], np.ndarray] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Messages of the blocks of docs.

    send(block, kind, ids, texts) yields (shard, payload).  Documents of
    another kind (0 to 3) are never in the same block.  A block's number holds
    its partition, place and kind, so a rerun of a lost task and a second pass
    over the same input repeat it.
    """

    def run(batches):
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 26, 0
        held: dict[int, list] = {}

        def close(k):
            nonlocal n
            ids, texts, _ = held.pop(k)
            block = base + 4 * n + k
            out = [(block, s, p) for s, p in send(block, k, np.array(ids, np.int64), texts)]
            n += 1
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[at : at + 64]), _MESSAGE.types)], schema=_MESSAGE)

        for batch in sliced(batches, 1):
            ids, texts = column_ids(batch.column(0)), column_bytes(batch.column(1))
            kinds = np.zeros(len(ids), int) if kind is None else kind(ids)
            for i, t, k in zip(ids.tolist(), texts, kinds.tolist()):
                x = held.setdefault(k, [[], [], 0])
                x[0].append(i)
                x[1].append(t)
                x[2] += len(t) + 64
                if x[2] >= block_bytes:
                    yield from close(k)
        for k in list(held):
            yield from close(k)
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, MESSAGE)


def answers(messages: DataFrame, answer: Callable[[int, list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """For each shard, answer(shard, blocks, payloads) yields (block, payload)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        shard = key[0].as_py()
        out = list(answer(shard, table.column("block").to_pylist(), table.column("payload").to_pylist()))
        release()
        return pa.Table.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([shard] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary())], schema=_MESSAGE)

    return messages.groupBy("shard").applyInArrow(run, MESSAGE)


def receive(texts: DataFrame, replies: DataFrame, take: Callable[[int, bytes, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """Each block's text payload together with its replies by shard, through take(block, payload, replies)."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        body = left.column("payload").to_pylist()
        if len(body) != 1:
            raise RuntimeError("answers without their block: the input's rows are not dealt alike on each read")
        got = dict(zip(right.column("shard").to_pylist(), right.column("payload").to_pylist()))
        out = take(key[0].as_py(), body[0], got)
        release()
        return out

    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)
