"""Substring dedup with FM-indexes.

A window is `window` consecutive words.  Every window has a minimizer, the
k-gram of words with the smallest hash in it; equal windows have equal ones.
Runs of windows with one minimizer are segments, and a segment belongs to the
shard of its minimizer, so all occurrences of a window meet in one shard and
shards are as many as the corpus needs; no document visits all of them.

1. Blocks of documents (see `exchange`) send their distinct minimizers; shards
   say which are in two documents or more.  Others cannot be in a repeat.
2. Blocks send the segments of shared minimizers, each distinct one once with
   its smallest holder.  A shard builds the FM-index of its distinct segments,
   streams them through it by backward search, and gets, for every window whose
   matching statistic reaches the window length, the smallest document among
   its interval's suffixes.  A bit for each window goes back: whether that
   document is smaller than the sender's.
3. Blocks mark the words that the windows cover and delete them.

A passage that many documents share is one segment a block in one shard,
whatever the number of its copies.

Words travel as 40 bits of their hashes.

A text is held whole by one task, whose arrays take some thirty times its size.

Defined cases: null and short texts have no window; white space between kept
words becomes one space; a null identifier is larger than all others; rows with
equal identifiers do not count as earlier to each other; repeats inside one
document alone stay; an empty table gives an empty result.
"""
from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import MESSAGE, answers, blocks, by_shard, expand, pack, pack_sorted, pack_texts, receive, squeeze, unpack, unpack_sorted, unpack_texts
from .fm_index import FMIndex
from .session import checkpointed, partitions, text_bytes
from .words import NO_ID, Words, mix, window_hash

GRAM = 5
WORD_BYTES = 5
#: bytes of text in a block: its words' arrays take some thirty times as much
BLOCK_BYTES = 3 << 20
#: bytes of text for which there is a shard, at least
SHARD_BYTES = 32 << 20
_SECOND = 1 << 20
_ODD = 0xD6E8FEB86659FD93
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


class Segmented:
    """Words of a block's texts, cut into segments: runs of windows of one text that share their minimizer."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int):
        words = Words(texts)
        self.words, self.ids, self.window = words, ids, window
        n = len(words.hash)
        windows = n - window + 1
        if windows <= 0:
            self.start = self.count = self.key = self.owner = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        gram = min(GRAM, window)
        g = window_hash(words.hash, gram)
        least, place = g[:windows].copy(), np.arange(windows)
        for j in range(1, window - gram + 1):
            lower = g[j : j + windows] < least
            least[lower] = g[j : j + windows][lower]
            place[lower] = np.flatnonzero(lower) + j
        owner = words.text_of()
        inside = owner[:windows] == owner[window - 1 :]
        new = np.ones(windows, bool)
        new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
        run = np.cumsum(new & inside) - 1
        run = run[inside]
        self.start = np.flatnonzero(new & inside)
        self.count = np.bincount(run, minlength=len(self.start))
        # minimizers crowd at the low end of the hash range; mixed again they fill all shards alike
        self.key, self.owner = mix(least[self.start] ^ np.uint64(_ODD)), owner[self.start]

    def contents(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the chosen segments: (hash of content, number of words)."""
        n = len(self.words.hash)
        steps = np.full(n + 1, _ODD, np.uint64)
        steps[:1] = 1
        up = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = np.uint64(_ODD_INVERSE)
        down = np.cumprod(steps, dtype=np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words.hash * up[:-1], out=total[1:])
        a, size = self.start[chosen], self.count[chosen] + self.window - 1
        return mix((total[a + size] - total[a]) * down[a] + size.astype(np.uint64)), size

    def distinct(self, chosen: np.ndarray):
        """(one of the chosen for each content, in key order; smallest holder of each; place of each chosen one among them)."""
        content, _ = self.contents(chosen)
        holder = self.ids[self.owner[chosen]]
        order = np.lexsort((holder, content, self.key[chosen]))
        key, content = self.key[chosen][order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        heads = order[new]
        return chosen[heads], holder[heads], back


def _send_texts(block, kind, ids, texts):
    yield -1, pack_texts(ids, texts)


def _send_minimizers(shards: int, window: int):
    def send(block, kind, ids, texts):
        s = Segmented(ids, texts, window)
        # in two documents of the block already, or in one
        order = np.lexsort((s.owner, s.key))
        key, owner = s.key[order], s.owner[order]
        head = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        distinct = key[head]
        many = owner[head] != owner[np.append(head[1:], len(key)) - 1] if len(head) else np.zeros(0, bool)
        for k, at in by_shard(distinct, shards):
            yield k, pickle.dumps((pack_sorted(distinct[at]), np.packbits(many[at]).tobytes()))

    return send


def _shared(shard, ids, payloads):
    parts = [pickle.loads(p) for p in payloads]
    keys = [unpack_sorted(p[0]) for p in parts]
    many = np.concatenate([np.unpackbits(np.frombuffer(p[1], np.uint8), count=len(k)) for p, k in zip(parts, keys)])
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    shared = np.bincount(back, 1 + many.astype(np.int64), len(distinct)) > 1
    at = 0
    for block, k in zip(ids, keys):
        yield block, squeeze(np.packbits(shared[back[at : at + len(k)]]).tobytes())
        at += len(k)


def _chosen(s: Segmented, got: dict[int, bytes], shards: int) -> np.ndarray:
    """Segments whose minimizer is shared."""
    distinct, back = np.unique(s.key, return_inverse=True)
    shared = np.zeros(len(distinct), bool)
    for k, at in by_shard(distinct, shards):
        if k not in got:
            raise RuntimeError("a block and its answers differ: the input's rows are not dealt alike on each read")
        shared[at] = np.unpackbits(np.frombuffer(expand(got[k]), np.uint8), count=at.stop - at.start).astype(bool)
    return np.flatnonzero(shared[back])


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., of all ranges."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))


def _short(hashes: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, 8 - WORD_BYTES :]).tobytes())


def _long(data: bytes) -> np.ndarray:
    raw = np.frombuffer(expand(data), np.uint8).reshape(-1, WORD_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :WORD_BYTES] = raw
    return out.view(np.uint64).ravel()


def _send_segments(shards: int, window: int):
    def take(block, payload, got):
        s = Segmented(*unpack_texts(payload), window)
        chosen = _chosen(s, got, shards)
        one, holder, _ = s.distinct(chosen)
        out = []
        for k, at in by_shard(s.key[one], shards):
            mine = one[at]
            size = s.count[mine] + window - 1
            out.append((k, pickle.dumps((pack(s.count[mine].astype(np.uint8 if window < 200 else np.uint16)), pack(holder[at]), _short(s.words.hash[_flat(s.start[mine], size)])))))
        shard, body = zip(*out) if out else ((), ())
        return pa.table({"block": pa.array([block] * len(out), pa.int64()), "shard": pa.array(shard, pa.int32()), "payload": pa.array(body, pa.binary())})

    return take


def earliest_holders(words: np.ndarray, count: np.ndarray, holder: np.ndarray, window: int) -> np.ndarray:
    """The smallest holder of each window of the segments (count windows each, laid end to end in words), through an FM-index of the distinct segments."""
    size = count.astype(np.int64) + window - 1
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    symbol = np.unique(words, return_inverse=True)[1] + 1
    # equal segments once, with their smallest holder
    total = np.zeros(len(words) + 1, np.uint64)
    steps = np.full(len(words) + 1, _ODD, np.uint64)
    steps[:1] = 1
    up = np.cumprod(steps, dtype=np.uint64)
    steps[1:] = np.uint64(_ODD_INVERSE)
    down = np.cumprod(steps, dtype=np.uint64)
    np.cumsum(mix(symbol.astype(np.uint64)) * up[:-1], out=total[1:])
    content = mix((total[start + size] - total[start]) * down[start] + size.astype(np.uint64))
    _, one, back = np.unique(content, return_index=True, return_inverse=True)
    least = np.full(len(one), NO_ID)
    np.minimum.at(least, back, holder)
    own_size = size[one]
    text = np.zeros(int(own_size.sum()) + len(one), np.int64)
    at = np.concatenate([[0], np.cumsum(own_size + 1)[:-1]])
    text[_flat(at, own_size)] = symbol[_flat(start[one], own_size)]
    index = FMIndex(text, window)
    length, row = index.matching_statistics(text, at, own_size)
    # the smallest holder in the interval of each full match
    begin, _ = index.blocks(window)
    owner = least[np.repeat(np.arange(len(one)), own_size + 1)][index.suffixes]
    heads = np.flatnonzero(begin == np.arange(index.n))
    smallest = np.minimum.reduceat(owner, heads)
    windows = own_size - window + 1
    where = _flat(at, windows)
    assert (length[where] == window).all()
    found = smallest[np.searchsorted(heads, row[where])]
    first = np.concatenate([[0], np.cumsum(windows)[:-1]])
    return found[_flat(first[back], windows[back])]


def _answer_segments(window: int):
    def answer(shard, ids, payloads):
        parts = [pickle.loads(p) for p in payloads]
        counts, holders = [unpack(p[0]).astype(np.int64) for p in parts], [unpack(p[1]) for p in parts]
        count, holder = np.concatenate(counts), np.concatenate(holders)
        earliest = earliest_holders(np.concatenate([_long(p[2]) for p in parts]), count, holder, window)
        bits = earliest < np.repeat(holder, count)
        at = 0
        for block, c in zip(ids, counts):
            n = int(c.sum())
            yield block, squeeze(np.packbits(bits[at : at + n]).tobytes())
            at += n

    return answer


_OUT = "doc_id long, n_words long, n_removed long, kept binary, removed_start array<long>, removed_length array<long>"


def _delete(shards: int, window: int):
    def take(block, payload, got):
        ids, texts = unpack_texts(payload)
        s = Segmented(ids, texts, window)
        chosen = _chosen(s, {k: v for k, v in got.items() if k < _SECOND}, shards)
        one, holder, back = s.distinct(chosen)
        windows = s.count[one]
        first = np.concatenate([[0], np.cumsum(windows)])
        earlier = np.zeros(int(first[-1]), bool)
        for k, at in by_shard(s.key[one], shards):
            a, b = int(first[at.start]), int(first[at.stop])
            earlier[a:b] = np.unpackbits(np.frombuffer(expand(got[k + _SECOND]), np.uint8), count=b - a)
        # a holder other than the block's smallest is behind that one
        count = s.count[chosen]
        covered = earlier[_flat(first[back], count)] | np.repeat(s.ids[s.owner[chosen]] > holder[back], count)
        begin = _flat(s.start[chosen], count)[covered]
        n = len(s.words.start)
        edge = np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(begin + window, minlength=n + 1)[: n + 1]
        gone = np.cumsum(edge)[:n] > 0
        bounds = s.words.first
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[bounds])
        kept, starts, sizes = [], [], []
        for t, a, b, r in zip(texts, bounds.tolist(), bounds[1:].tolist(), removed.tolist()):
            words = t.split()
            if not r:
                kept.append(b" ".join(words))
                starts.append([])
                sizes.append([])
                continue
            mine = gone[a:b]
            kept.append(b" ".join([w for w, g in zip(words, mine.tolist()) if not g]))
            change = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
            starts.append(change[0::2])
            sizes.append(change[1::2] - change[0::2])
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
                "n_words": pa.array(np.diff(bounds), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
                "removed_start": pa.array(starts, pa.list_(pa.int64())),
                "removed_length": pa.array(sizes, pa.list_(pa.int64())),
            }
        )

    return take


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (remaining words joined by one space, UTF-8), removed_start and removed_length (word spans)."""
    shards = max(8, 4 * partitions(docs.sparkSession), -(-text_bytes(docs, text_col) // SHARD_BYTES))
    dealt = {"id_col": id_col, "text_col": text_col, "block_bytes": BLOCK_BYTES}
    texts = blocks(docs, _send_texts, **dealt)
    shared = checkpointed(answers(blocks(docs, _send_minimizers(shards, window), **dealt), _shared))
    segments = receive(texts, shared, _send_segments(shards, window), MESSAGE)
    earlier = checkpointed(answers(segments, _answer_segments(window)))
    replies = shared.union(earlier.selectExpr("block", f"shard + {_SECOND} AS shard", "payload"))
    return receive(texts, replies, _delete(shards, window), _OUT)
