"""Vectorised word handling on UTF-8 bytes.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  All of a
batch's texts are laid in one byte buffer, each followed by a newline, and the
word bounds and 64-bit word hashes of the whole buffer come from a handful of
numpy passes, with no Python work per word.
"""
from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 63, dtype=np.uint64)) | 1
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: sorts after every real document identifier; stands for a null one
NO_ID = np.iinfo(np.int64).max


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on uint64 (new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n-1) modulo 2**64, kept between calls up to a fixed length."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 1 << 22:
            _POWERS[kind] = have
    return have[:n]


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts each followed by a newline, offsets of the texts; len(texts)+1)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return buf, np.concatenate([[0], np.cumsum(sizes)])


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of a byte buffer, in order and without overlap."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(out):  # in pieces, so the power tables stay small
        lo = start[at]
        to = max(int(np.searchsorted(end, lo + (1 << 21), "right")), at + 1)
        piece = buf[lo : end[to - 1]]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * _powers("up", _BASE, len(piece)), out=total[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        out[at:to] = mix((total[e] - total[s]) * _powers("down", _INV, len(piece))[s] + (e - s).astype(np.uint64))
        at = to
    return out


class Words:
    """Words of a list of texts: start and end byte, 64-bit hash, and bounds of each text's words."""

    __slots__ = ("buf", "start", "end", "hash", "first")

    def __init__(self, texts: list[bytes], lower: bool = False, hashed: bool = True):
        buf, offsets = layout(texts)
        self.buf = _LOWER[buf] if lower else buf
        inside = ~_SPACE[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(buf) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        #: words first[i]:first[i+1] belong to text i
        self.first = np.searchsorted(self.start, offsets)
        self.hash = span_hashes(self.buf, self.start, self.end) if hashed else None

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (len - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[j : j + n]
    return mix(out)


def utf8(value) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass") if isinstance(value, str) else value


_frozen = False


def release() -> None:
    """Gives freed memory of a Python worker, which lives on for other tasks, back to the machine.

    Few objects hold much memory here, so cycles that hold tables would wait
    long for a collection; what was there at first is frozen to keep it cheap.
    """
    import ctypes
    import gc

    import pyarrow as pa

    global _frozen
    if not _frozen:
        gc.freeze()
        _frozen = True
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def sliced(batches, column: int, size: int = 4 << 20):
    """Arrow batches cut into pieces of about `size` bytes of a string column, so that whole batches are never copied into Python at once."""
    import pyarrow.compute as pc

    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        piece = np.cumsum(lengths + 64) // size
        cut = np.concatenate([[0], np.flatnonzero(piece[1:] != piece[:-1]) + 1, [len(lengths)]]) if len(lengths) else np.zeros(2, int)
        for a, b in zip(cut.tolist(), cut[1:].tolist()):
            yield batch.slice(a, b - a)
    release()


def column_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def column_ids(column) -> np.ndarray:
    """An Arrow integer column as int64 with null as NO_ID."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(column.cast(pa.int64()), NO_ID))


def ids_column(ids: np.ndarray):
    import pyarrow as pa

    return pa.array(ids, pa.int64(), mask=ids == NO_ID)
