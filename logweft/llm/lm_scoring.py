"""Language-model scoring by deleted interpolation (Jelinek and Mercer, 1980).

The probability of a token is a mixture of the bigram's and the unigram's
maximum-likelihood estimates and a uniform share for tokens never seen, the
weights depending on the bucket of the context's frequency.  The weights are
learned by expectation-maximisation on a part of the training documents that
was deleted from the counts; then that part's counts are added back.

Counts cover all training text.  Documents are dealt into blocks (see
`exchange`); blocks hold either retained, deleted or held-out documents.  A
block sends its distinct unigram and bigram keys with their counts to shards of
the key space, a shard adds them up over all blocks and sends back the totals
for the keys each block has, and the block scores its texts.  So nothing is
broadcast but the weights, what moves grows with the corpus, and a frequent
word is one entry a block.  Deleted blocks answer first: from their tokens'
estimates the weights are learned, out of one bounded histogram.

Keys are hashes of 64 bits (unigrams) and 56 bits (bigrams).

Defined cases: null and empty texts are the end token alone; a null identifier
is held out (its remainder is not known) and is not learned from; repeated
identifiers are documents of their own; with no training text all counts and N
are 0 and every token has probability 1; an empty table gives an empty result.
"""
from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import answers, blocks, by_shard, pack, pack_sorted, pack_texts, receive, unpack, unpack_sorted, unpack_texts
from .session import checkpointed, partitions, text_bytes
from .words import NO_ID, Words, mix

RETAINED, DELETED, HELD_OUT = 0, 1, 2
#: one training document in so many goes to the deleted part
DELETED_SHARE = 10
#: buckets of context frequency: 0, 1, 2-3, 4-7, ...
BUCKETS = 24
#: estimates in the histogram are binned to so many steps an octave
STEPS, OCTAVES = 4, 40
#: bytes of text for which there is a shard, at least
SHARD_BYTES = 64 << 20
_END = np.uint64(0x5851F42D4C957F2D)
_START = np.uint64(0x14057B7EF767814F)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unigram keys of all texts, each text closed by the end token; bigram keys, of each token with the one before; bounds)."""
    words = Words(texts, lower=True)
    keys = np.insert(words.hash, words.first[1:], _END)
    bounds = words.first + np.arange(len(words.first))
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[bounds[:-1]] = _START
    pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(keys ^ np.uint64(0xD1B54A32D192ED03))) >> np.uint64(8) << np.uint64(8)
    return keys, pair, bounds


def fold_of(ids: np.ndarray, learn) -> np.ndarray:
    """Kind of each document: learn(id) says whether it is learned from."""
    out = np.empty(len(ids), int)
    for k, i in enumerate(ids.tolist()):
        out[k] = HELD_OUT if i == NO_ID or not learn(i) else DELETED if zlib.crc32(b"%d/deleted" % i) % DELETED_SHARE == 0 else RETAINED
    return out


def not_every_seventh(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 7 != 2


def _send_texts(only: int | None = None):
    def send(block, kind, ids, texts):
        if only is None or kind == only:
            yield -1, pack_texts(ids, texts)

    return send


def _send_keys(shards: int):
    def send(block, kind, ids, texts):
        uni, pair, _ = tokens(texts)
        # two key spaces: shards of unigrams, then shards of bigrams
        for base, keys in ((0, uni), (shards, pair)):
            distinct, n = np.unique(keys, return_counts=True)
            n = n.astype(np.uint16 if n.max(initial=0) < 1 << 16 else np.uint32)
            for s, at in by_shard(distinct, shards):
                yield base + s, pickle.dumps((kind, pack_sorted(distinct[at] >> np.uint64(8) if base else distinct[at]), pack(n[at])))

    return send


def _answer(shards: int):
    def answer(shard, ids, payloads):
        parts = [pickle.loads(p) for p in payloads]
        kinds, keys, counts = [p[0] for p in parts], [unpack_sorted(p[1]) for p in parts], [unpack(p[2]).astype(np.int64) for p in parts]
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros((2, len(distinct)), np.int64)
        edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        spans = list(zip(edges.tolist(), edges[1:].tolist()))
        for kind, n, (a, b) in zip(kinds, counts, spans):
            if kind != HELD_OUT:
                total[kind][back[a:b]] += n  # a block's keys are distinct
        trained = total.sum(0)
        if shard < shards:
            end = distinct == _END
            yield -1, pickle.dumps([int(x) for t in (total[0], trained) for x in (t.sum(), (t > 0).sum(), t[end].sum())])
        for block, (a, b) in zip(ids, spans):
            got = total[:, back[a:b]]
            small = np.uint8 if got.max(initial=0) < 1 << 8 else np.uint16 if got.max() < 1 << 16 else np.uint32 if got.max() < 1 << 32 else np.int64
            yield block, pickle.dumps((pack(got[0].astype(small)), pack(got[1].astype(small))))

    return answer


class Counts:
    """A block's documents with the corpus counts of their tokens."""

    def __init__(self, payload: bytes, got: dict[int, bytes], shards: int, part: slice):
        """part: 0:1 for the retained counts alone, 0:2 for all."""
        self.ids, texts = unpack_texts(payload)
        uni, pair, self.bounds = tokens(texts)
        self.word = self._of(uni, got, 0, shards, part)
        self.pair = self._of(pair, got, shards, 2 * shards, part)
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.first = self.bounds[:-1]

    @staticmethod
    def _of(keys, got, low, high, part):
        distinct, back = np.unique(keys, return_inverse=True)
        answers = [pickle.loads(got[s]) for s in range(low, high) if s in got]
        total = sum(np.concatenate([unpack(a[k]).astype(np.int64) for a in answers]) for k in range(*part.indices(2)))
        if len(total) != len(distinct):
            raise RuntimeError("a block and its answers differ: the input's rows are not dealt alike on each read")
        return total[back]


def bucket(n: np.ndarray) -> np.ndarray:
    """0 for no occurrence, else 1 + floor(log2 n), at most BUCKETS - 1."""
    return np.minimum(np.frexp(n.astype(np.float64))[1], BUCKETS - 1)


def estimates(counts: Counts, documents: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the context, bigram estimate, unigram estimate) of each token."""
    context = counts.context.copy()
    context[counts.first] = documents  # the start is the context of every document
    return bucket(context), np.where(context > 0, counts.pair / np.maximum(context, 1), 0.0), counts.word / max(total, 1)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for zero, else 1 .. STEPS * OCTAVES by the logarithm."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(STEPS * OCTAVES + np.round(STEPS * np.log2(np.maximum(p, 1e-300))), 1, STEPS * OCTAVES), 0).astype(np.int64)


_BINS = STEPS * OCTAVES + 1


def learn_weights(histogram: dict[int, int], distinct: int, rounds: int = 60) -> np.ndarray:
    """EM over {cell: tokens}, a cell being (bucket, bin of the bigram's, bin of the unigram's estimate) -> weights BUCKETS x 3 (bigram, unigram, uniform)."""
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    if histogram:
        cell, n = np.array(list(histogram), np.int64), np.array(list(histogram.values()), float)
        b, two, one = cell // (_BINS * _BINS), cell // _BINS % _BINS, cell % _BINS
        value = np.concatenate([[0.0], 2.0 ** ((np.arange(1, _BINS) - STEPS * OCTAVES) / STEPS)])
        p = np.stack([value[two], value[one], np.full(len(n), 1 / (distinct + 1))], 1)
        for _ in range(rounds):
            share = weights[b] * p
            share *= (n / share.sum(1))[:, None]
            # one pseudo-token a component keeps rare buckets and unseen tokens possible
            new = np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(3)], 1) + 1e-2
            weights = new / new.sum(1, keepdims=True)
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]  # an unseen context has no bigrams
    return weights


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, learn=not_every_seventh, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (the mixture's log10 probability)."""
    spark = docs.sparkSession
    shards = max(8, 2 * partitions(spark), -(-text_bytes(docs, text_col) // SHARD_BYTES))
    dealt = {"id_col": id_col, "text_col": text_col, "kind": lambda ids: fold_of(ids, learn)}
    replies = checkpointed(answers(blocks(docs, _send_keys(shards), **dealt), _answer(shards)))
    facts = [pickle.loads(bytes(r.payload)) for r in replies.where("block < 0").select("payload").collect()]  # one row a shard
    kept, kept_distinct, n_kept, total, distinct, n_all = np.sum([[0] * 6, *facts], 0, dtype=np.int64).tolist()
    got = replies.where("block >= 0")

    def cells(block, payload, replies):
        b, two, one = estimates(Counts(payload, replies, shards, slice(0, 1)), n_kept, kept)
        cell, n = np.unique((b.astype(np.int64) * _BINS + _bin(two)) * _BINS + _bin(one), return_counts=True)
        return pa.table({"cell": pa.array(cell), "n": pa.array(n.astype(np.int64))})

    deleted = blocks(docs, _send_texts(DELETED), **dealt)
    histogram = receive(deleted, got.where(F.col("block").bitwiseAND(3) == DELETED), cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    held = spark.sparkContext.broadcast(learn_weights({r.cell: r.n for r in histogram}, kept_distinct))

    def score(block, payload, replies):
        counts = Counts(payload, replies, shards, slice(0, 2))
        b, two, one = estimates(counts, n_all, total)
        w = held.value[b]
        p = w[:, 0] * two + w[:, 1] * one + w[:, 2] / (distinct + 1)
        base = np.log10((counts.word + 1) / (total + distinct + 1))
        at = counts.bounds[:-1]
        add = lambda x: np.add.reduceat(x, at)  # noqa: E731  every text has a token at least
        none = total == 0
        return pa.Table.from_arrays(
            [
                pa.array(counts.ids, pa.int64(), mask=counts.ids == NO_ID),
                pa.array(fold_of(counts.ids, learn) == HELD_OUT),
                pa.array(np.diff(counts.bounds)),
                pa.array(add((counts.word > 0).astype(np.int64))),
                pa.array(np.full(len(at), total)),
                pa.array(add(base)),
                pa.array(np.zeros(len(at)) if none else add(np.log10(p))),
            ],
            schema=_SCORED,
        )

    return receive(blocks(docs, _send_texts(), **dealt), got, score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
