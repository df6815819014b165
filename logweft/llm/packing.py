"""Packing along a space-filling curve.

A document's token bag is projected by hashed signs onto a few dimensions,
its place there becomes a Hilbert key, documents are range-sorted by (key,
identifier), and each partition lays its documents end to end along the curve,
cutting every `length` tokens, so a sequence holds neighbouring documents and
no padding.  What a partition has left at its end is cut into sequences whose
lengths are powers of two, which need no padding either.  The identifier in
the range key spreads groups of copies, which share a key, over partitions.

Distinct pieces of words of a batch are tokenised once; a cache of fixed size
serves those of later batches.

Defined cases: null and empty texts are the end token alone; null identifiers
sort last; repeated identifiers are documents of their own; an empty table
gives an empty result.
"""
from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hilbert import hilbert_key
from .session import checkpointed, partitions
from .words import Words, column_bytes, column_ids, ids_column, release, sliced, span_hashes

DIMENSIONS, DIMENSION_BITS = 4, 10
CACHE_WORDS = 3 << 17
BATCH_BYTES = 2 << 20
#: pieces in one call of the tokenizer
SLICE = 4096


#: the form of tokenizer that `WordTokenizer` takes apart: NFC, white space, lower case; letters, single digits, other runs; bytes
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _takes_pieces(config: dict) -> bool:
    steps = [(x["type"], x.get("pattern")) for x in ((config.get("normalizer") or {}).get("normalizers") or [])]
    cut = ((config.get("pre_tokenizer") or {}).get("pretokenizers")) or []
    return (
        steps == [("NFC", None), ("Replace", {"Regex": "\\s+"}), ("Lowercase", None)]
        and [x["type"] for x in cut] == ["Split", "ByteLevel"]
        and cut[0]["pattern"] == {"Regex": _SPLIT}
        and cut[0]["behavior"] == "Removed"
        and cut[0]["invert"]
        and not cut[1]["add_prefix_space"]
        and not cut[1]["use_regex"]
        and config.get("post_processor") is None
    )


def _byte_letters() -> dict[int, int]:
    """Byte-level tokenizers write each byte as a printable character: itself, or one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in set(plain))}


_LETTERS = _byte_letters()
_SPACE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)
_CLASS = np.full(256, _HARD, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[[0x27, 0x7C]] = _HARD  # an apostrophe or a bar: contractions, special tokens


class WordTokenizer:
    """Token ids of whole texts, each distinct piece tokenised once.

    For tokenizers of the form above, texts are cut in numpy into runs of ASCII
    and Latin-1 letters, digits and other ASCII, which the model takes as they
    are; a word with anything else goes through the whole tokenizer.  Texts for
    other tokenizers are encoded whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.cuts = _takes_pieces(json.load(f))
        self.model = Tokenizer(self.tokenizer.model)
        self._clear()

    def _clear(self):
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes], hard: np.ndarray):
        sizes, flat = [], []
        for a in range(0, len(pieces), SLICE):
            part, is_hard = pieces[a : a + SLICE], hard[a : a + SLICE].tolist()
            easy = self.model.encode_batch_fast([p.decode("ascii") if p.isascii() else p.decode("latin-1").translate(_LETTERS) for p, h in zip(part, is_hard) if not h], add_special_tokens=False)
            full = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p, h in zip(part, is_hard) if h], add_special_tokens=False)
            easy, full = iter(easy), iter(full)
            for h in is_hard:
                ids = next(full if h else easy).ids
                sizes.append(len(ids))
                flat += ids
        size = np.array(sizes, np.int64)
        at = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.ids = np.concatenate([self.ids, np.array(flat, np.uint32)])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.at, self.size = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def _pieces(self, texts: list[bytes]):
        """(buffer, starts, ends, whether hard, first piece of each text and the end)."""
        words = Words(texts, lower=True, hashed=False)
        buf = words.buf.copy()
        kind = _CLASS[buf]
        # two-byte letters U+00C0..U+00FF but the signs of multiplication and division, lower-cased
        lead = np.flatnonzero(buf[:-1] == 0xC3)
        lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        upper = lead[(buf[lead + 1] <= 0x9E)] + 1
        buf[upper] += 0x20
        bad = np.concatenate([[0], np.cumsum(kind == _HARD)])
        hard = bad[words.end] > bad[words.start]
        edge = np.zeros(len(buf) + 1, np.int8)
        edge[words.start[hard]] = 1
        edge[words.end[hard]] = -1
        kind[np.cumsum(edge[:-1], dtype=np.int8) > 0] = _HARD
        new = np.ones(len(buf), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(buf))
        solid = kind[heads] != _SPACE
        heads, tails = heads[solid], tails[solid]
        offsets = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
        return buf, heads, tails, kind[heads] == _HARD, np.searchsorted(heads, offsets)

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by end; bounds of the texts)."""
        if not self.cuts:
            got = [[*self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, end] for t in texts]
            return np.array([i for x in got for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in got])])
        buf, start, stop, hard, first = self._pieces(texts)
        hashes = span_hashes(buf, start, stop)
        back, distinct = pd.factorize(hashes)
        if len(self.known) > CACHE_WORDS:
            self._clear()
        spot = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = self.known[spot] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            one = np.empty(len(distinct), np.int64)
            one[back] = np.arange(len(back))
            one, raw = one[new], buf.tobytes()
            self._learn(distinct[new], [raw[a:b] for a, b in zip(start[one].tolist(), stop[one].tolist())], hard[one])
            spot = np.searchsorted(self.known, distinct)
        size, at = (self.size[spot][back], self.at[spot][back]) if len(distinct) else (np.zeros(0, np.int64),) * 2
        # the end of each text is one more piece of one id
        gaps = first[1:]
        size, at = np.insert(size, gaps, 1), np.insert(at, gaps, -1)
        bounds = np.concatenate([[0], np.cumsum(size)])
        from_text = np.repeat(at >= 0, size)
        source = np.repeat(at - bounds[:-1], size) + np.arange(bounds[-1])
        source[~from_text] = len(self.ids)
        ids = np.append(self.ids, np.uint32(end))[source]
        last = gaps + np.arange(1, len(texts) + 1)
        return ids, np.concatenate([[0], bounds[last]])


def curve_keys(ids: np.ndarray, bounds: np.ndarray, seed: int = 11) -> np.ndarray:
    """Hilbert keys of documents: hashed signs of their tokens added up, scaled and placed in a grid."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 ^ seed)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    size = np.diff(bounds)
    out = np.empty((len(size), DIMENSIONS), np.int64)
    for k in range(DIMENSIONS):
        sign = ((h >> np.uint64(40 + k)) & np.uint64(1)).astype(np.int32)
        total = 2 * np.add.reduceat(sign, bounds[:-1]) - size
        # tanh spreads the sums, about normal after scaling, over the grid
        out[:, k] = ((np.tanh(total / np.sqrt(size) * 0.6) + 1) / 2 * ((1 << DIMENSION_BITS) - 1)).astype(np.int64)
    return hilbert_key(out, DIMENSION_BITS)


_TOKENS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("ids", pa.binary())])


@lru_cache(1)
def _tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process: tasks share its cache."""
    return WordTokenizer(path)


def _tokenise(path: str, end: int):
    def run(batches):
        tokenizer = _tokenizer(path)
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def flush(ids, texts):
            tokens, bounds = tokenizer.encode(texts, end)
            key = curve_keys(tokens, bounds)
            raw = tokens.astype(np.uint16 if not len(tokens) or tokens.max() < 1 << 16 else np.uint32)
            mark = b"2" if raw.itemsize == 2 else b"4"
            b = bounds.tolist()
            body = [mark + squeeze(raw[x:y].tobytes()) for x, y in zip(b, b[1:])]
            return pa.RecordBatch.from_arrays([ids_column(ids), pa.array(key), pa.array(body, pa.binary())], schema=_TOKENS)

        for batch in sliced(batches, 1, BATCH_BYTES):
            if len(batch):
                yield flush(column_ids(batch.column(0)), column_bytes(batch.column(1)))

    return run


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pack(length: int, with_ids: bool):
    schema = _PIECE.append(pa.field("ids", pa.binary())) if with_ids else _PIECE

    def run(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        open_, filled, out = [], 0, []
        expand = zstandard.ZstdDecompressor().decompress

        def piece(doc, start, ids, total, offset):
            raw = ids.astype("<u4").tobytes()
            return (doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, *([raw] if with_ids else []))

        def flush():
            doc, *rest = zip(*out)
            arrays = [ids_column(np.array(doc, np.int64)), *[pa.array(x, f.type) for x, f in zip(rest, list(schema)[1:])]]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for doc, body in zip(column_ids(batch.column(0)).tolist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(expand(body[1:]), np.uint16 if body[:1] == b"2" else np.uint32)
                at = 0
                while at < len(ids):
                    take = min(length - filled, len(ids) - at)
                    open_.append((doc, at, ids[at : at + take], len(ids), filled))
                    at, filled = at + take, filled + take
                    if filled == length:
                        out.extend(piece(*x) for x in open_)
                        open_, filled, sequence = [], 0, sequence + 1
                if len(out) >= 8192:
                    yield flush()
        # the rest, in sequences of 1024, 512, ... tokens
        queue, size = open_[::-1], 1 << max(filled.bit_length() - 1, 0)
        offset = 0
        while queue:
            while not filled & size:
                size >>= 1
            doc, start, ids, total, _ = queue.pop()
            take = min(size - offset, len(ids))
            out.append(piece(doc, start, ids[:take], total, offset))
            if take < len(ids):
                queue.append((doc, start + take, ids[take:], total, 0))
            offset += take
            if offset == size:
                filled, sequence, offset = filled ^ size, sequence + 1, 0
        if out:
            yield flush()
        release()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids themselves (little-endian unsigned 32-bit)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = checkpointed(rows.mapInArrow(_tokenise(tokenizer_path, end), "doc_id long, key long, ids binary"))
    place = ("key", F.col("doc_id").asc_nulls_last())
    curve = tokens.repartitionByRange(partitions(docs.sparkSession), *place).sortWithinPartitions(*place).select("doc_id", "ids")
    types = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return curve.mapInArrow(_pack(length, with_ids), types)
