"""Local outlier factor of lines inside their clusters, by byte-level Levenshtein distance.

Equal lines of a cluster share all their values, so the operator works on a
cluster's distinct texts, each with the number of lines that have it.  Texts are
dealt into tiles of TILE by cluster; a task takes blocks of tiles, half of all
pairs, and reduces their distances at once (`tiles.reduced`).  Three such passes
give each text's distance to its k-th neighbour, its density and its factor:
what is stored and moved is a few numbers a text and block, never a distance of
a pair, however large a cluster is and however many neighbours tie.

Clusters that fit one task and whose texts, without what all begin and end with,
are short go another way: pairs within two edits come from equal remains of two
deletions, and where these give a text fewer than k lines it is compared with
all.  A cluster whose candidates or pairs are too many for that is left to the
passes, so factors are the same.
"""
from __future__ import annotations

from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levenshtein import Side, _cut, side_table
from ..functions.numbering import checkpointed, numbered_within, spread
from .tiles import Tile, hits, least, packed, reduced

EPSILON = 2.220446049250313e-16
#: distinct texts of a tile, about
TILE = 1024
#: distinct texts of a cluster that one task takes, from and to, and bytes of its longest one's middle
ALONE, ALONE_BYTES = (1 << 12, 1 << 16), 16
#: pairs that such a task holds, and pairs of texts that it compares for those without near ones
PAIRS, COMPARED = 1 << 22, 1 << 27


def _passes(texts: DataFrame, columns: list[str], reduction, schema: str) -> DataFrame:
    """reduction over all pairs of tiles of each label, for both sides; texts (label, tile, id, text, m, ...)."""
    return reduced(checkpointed(packed(texts, ["id", "text", "m", *columns], ["label"])), reduction, schema, ["label"], spread=spread)


class _Nearest:
    """Each text's distances to its k nearest lines."""

    FAR = np.iinfo(np.int64).max

    def __init__(self, k: int):
        self.k = k

    def start(self, x: Tile) -> list[np.ndarray]:
        return [x.id, np.full((len(x), self.k), self.FAR)]

    def step(self, d, mine: Tile, other: Tile, same: bool) -> None:
        near = mine.state[1]
        some = np.arange(len(mine)) if same else np.flatnonzero(d.min(1) < near[:, -1])
        if not len(some):
            return
        e, m = np.ascontiguousarray(d[some]), other["m"]
        top = np.iinfo(d.dtype).max  # no distance reaches it
        if same:  # both sides are the same texts in the same order; a line that is alone with its text is none of its own neighbours
            e = e.copy()
            single = np.flatnonzero(m == 1)
            e[single, single] = top
        at = least(e, self.k)
        lines = m[at] - (at == some[:, None]) if same else m[at]
        dist = np.take_along_axis(e, at, 1).astype(np.int64)
        dist = np.concatenate([np.where(dist == top, self.FAR, dist), np.full((len(some), 1), self.FAR)], 1)
        reached = np.cumsum(lines, 1)
        nth = np.stack([(reached < n).sum(1) for n in range(1, self.k + 1)], 1)
        near[some] = self._first(near[some], np.take_along_axis(dist, nth, 1))

    def _first(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sort(np.concatenate([a, b], 1), axis=1)[:, : self.k]

    def merge(self, a: list, b: list) -> list:
        return [a[0], self._first(a[1], b[1])]

    def finish(self, state: list) -> list:
        ids, near = state
        return [ids, pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), self.k).cast(pa.list_(pa.int64()))]


class _Sums:
    """Sum of a value over a text's neighbours, the lines within its distance to the k-th one without the line itself, and their number."""

    def start(self, x: Tile) -> list[np.ndarray]:
        return [x.id, np.zeros(len(x)), np.zeros(len(x), np.int64)]

    def step(self, d, mine: Tile, other: Tile, same: bool) -> None:
        a, b = hits(d <= np.minimum(mine["kdist"], np.iinfo(d.dtype).max).astype(d.dtype)[:, None])
        if not len(a):
            return
        w = other["m"][b] - (a == b) if same else other["m"][b]
        _, total, lines = mine.state
        total += np.bincount(a, self.value(d, a, b, other) * w, len(mine))
        lines += np.bincount(a, w, len(mine)).astype(np.int64)

    def merge(self, a: list, b: list) -> list:
        return [a[0], a[1] + b[1], a[2] + b[2]]

    def finish(self, state: list) -> list:
        return state


class _Reach(_Sums):
    def value(self, d, a, b, other: Tile):
        return np.maximum(d[a, b].astype(np.int64), other["kdist"][b])


class _Around(_Sums):
    def value(self, d, a, b, other: Tile):
        return other["lrd"][b]


def _within_two(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Edit distances of texts x and y (byte, pair) of sizes n and m; 3 stands for more than two."""
    width, far = len(x), np.uint8(3)
    out = np.full(x.shape[1], far)
    (low, high), (least_m, most_m) = ((int(v.min(initial=width)), int(v.max(initial=0))) for v in (n, m))
    # row i of the programme at columns i - 2 to i + 2
    row = [np.full(x.shape[1], min(abs(j), 3) if j >= 0 else 3, np.uint8) for j in range(-2, 3)]
    for i in range(width + 1):
        if i:
            new = []
            for c in range(5):
                j = i + c - 2
                if j < 0 or j > width:
                    cell = np.full(x.shape[1], far)
                elif j == 0:
                    cell = np.full(x.shape[1], min(i, 3), np.uint8)
                else:
                    cell = row[c] + (x[i - 1] != y[j - 1])
                    if c < 4:
                        np.minimum(cell, row[c + 1] + np.uint8(1), out=cell)
                    if new:
                        np.minimum(cell, new[-1] + np.uint8(1), out=cell)
                    np.minimum(cell, far, out=cell)
                new.append(cell)
            row = new
        if low <= i <= high:
            ends = n == i
            for c in range(max(0, least_m - i + 2), min(4, most_m - i + 2) + 1):
                np.copyto(out, row[c], where=ends & (m == i + c - 2))
    return out


def _near_pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(i, j, d) for all pairs i < j of different texts within two edits; None where candidates or pairs are too many."""
    many, size = len(texts), np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(size.max())
    x = np.zeros((width, many), np.uint8)
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        x[:n, own] = np.frombuffer(b"".join([texts[i] for i in own.tolist()]), np.uint8).reshape(len(own), n).T
    hashes, owners = [], []
    sizes = np.unique(size).tolist()
    for n in sizes:
        own = np.flatnonzero(size == n)
        for gone in range(2 if len(sizes) == 1 and n >= 2 else 0, min(n, 2) + 1):
            for drop in combinations(range(n), gone):
                h = np.full(len(own), n - gone + 1, np.uint64)
                for k in range(n):
                    if k not in drop:
                        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x[k, own]
                hashes.append(h)
                owners.append(own)
    h, at = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((at, h))
    h, at = h[order], at[order]
    once = np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1])])
    h, at = h[once], at[once]
    found, held, seen = [], 0, 0
    left = np.arange(len(h))
    for step in count(1):
        left = left[left < len(h) - step]
        left = left[h[left] == h[left + step]]
        if not len(left):
            break
        seen += len(left)
        if seen > max(many * many // 8, 1 << 16):
            return None
        a, b = at[left], at[left + step]
        for k in range(0, len(a), 1 << 14):
            i, j = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
            d = _within_two(x[:, i], size[i], x[:, j], size[j])
            near = d < 3
            found.append((i[near] * many + j[near]) * 4 + d[near])
            held += len(found[-1])
        if held > PAIRS:
            found = [np.unique(np.concatenate(found))]
            held = len(found[0])
            if held > PAIRS // 2:
                return None
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    if len(pairs) > PAIRS // 2:
        return None
    i, j = np.divmod(pairs >> 2, many)
    return i, j, pairs & 3


def _factors(texts: list[bytes], m: np.ndarray, k: int) -> np.ndarray | None:
    """LOF of a cluster's distinct texts, m lines each; None where it is not for one task."""
    many, k = len(texts), min(k, int(m.sum()) - 1)
    texts, _ = _cut(texts, [])
    if max(map(len, texts)) > ALONE_BYTES or (pairs := _near_pairs(texts)) is None:
        return None
    a, b = np.concatenate([pairs[0], pairs[1]]), np.concatenate([pairs[1], pairs[0]])
    d = np.concatenate([pairs[2], pairs[2]])
    kdist, lines = np.full(many, -1), m - 1  # a text's other lines are at no distance
    kdist[lines >= k] = 0
    for t in (1, 2):
        at = d == t
        lines = lines + np.bincount(a[at], m[b[at]], many).astype(np.int64)
        kdist[(kdist < 0) & (lines >= k)] = t
    lone = np.flatnonzero(kdist < 0)
    if len(lone) * many > COMPARED:
        return None
    if len(lone):
        every, room = Side(texts), PAIRS - len(a)
        more = [[x[kdist[a] >= 0] for x in (a, b, d)]]
        for c in range(0, len(lone), 256):
            own = lone[c : c + 256]
            table = side_table(Side([texts[i] for i in own.tolist()]), every)
            for t in range(3, int(table.max()) + 1):
                kdist[own[(kdist[own] < 0) & ((table <= t) @ m - 1 >= k)]] = t
            i, j = hits(table <= kdist[own].astype(table.dtype)[:, None])
            i, j = i[own[i] != j], j[own[i] != j]
            room -= len(i)
            if room < 0:
                return None
            more.append([own[i], j, table[i, j].astype(np.int64)])
        a, b, d = (np.concatenate(x) for x in zip(*more))
    near = d <= kdist[a]
    a, b, d = a[near], b[near], d[near]
    order = np.lexsort((b, a))
    a, b, d = a[order], b[order], d[order]
    w = np.bincount(a, m[b], many) + (m - 1)
    reach = np.bincount(a, np.maximum(d, kdist[b]) * m[b], many) + (m - 1) * kdist
    lrd = 1 / np.maximum(reach / w, EPSILON)
    around = np.bincount(a, lrd[b] * m[b], many) + (m - 1) * lrd
    return around / w / lrd


def _alone(texts: DataFrame, k: int) -> DataFrame:
    """(id, lof): texts (label, id, text, m) of the labels that one task can do, a task a label."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("text")
        lof = _factors(table.column("text").to_pylist(), table.column("m").to_numpy(), k)
        ids = table.column("id").combine_chunks()
        return pa.table([ids, pa.array(lof)] if lof is not None else [ids[:0], pa.array([], pa.float64())], ["id", "lof"])

    return spread(texts.select("label", "id", "text", "m"), "label").groupBy("label").applyInArrow(run, "id long, lof double")


def lof(labelled: DataFrame, k: int = 3) -> DataFrame:
    """labelled (row_id, label, raw) -> (row_id, label, n, lof); clusters of one or two lines have lof 0."""
    rows = labelled.where("label IS NOT NULL").select("row_id", "label", F.col("raw").cast("binary").alias("text"))
    texts = rows.groupBy("label", "text").agg(F.count(F.lit(1)).alias("m")).withColumn("id", F.monotonically_increasing_id())
    texts = checkpointed(texts)
    sizes = texts.groupBy("label").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("texts"))
    texts = checkpointed(texts.join(sizes, "label"))
    rest, scored = texts.where("n > 2").drop("texts"), None
    fits = texts.where("n > 2").where(F.col("texts").between(*ALONE))
    if not fits.isEmpty():
        scored = checkpointed(_alone(fits, k))
        rest = rest.join(scored.select("id"), "id", "left_anti")
    if scored is None or not rest.isEmpty():
        passed = _by_passes(rest, k)
        scored = passed if scored is None else scored.union(passed)
    scored = texts.join(scored, "id", "left").select("label", "text", "n", F.coalesce("lof", F.lit(0.0)).alias("lof"))
    return rows.join(scored, ["label", "text"]).select("row_id", "label", "n", "lof")


def _by_passes(texts: DataFrame, k: int) -> DataFrame:
    """(id, lof) of texts (label, id, text, m, n) by three passes over pairs of tiles."""
    # sorted texts of a tile begin alike
    large = numbered_within(texts, ["label"], ["text"], "at").withColumn("tile", F.floor(F.col("at") / TILE).cast("int")).drop("at").withColumn("k", F.least(F.lit(k), F.col("n") - 1))
    near = _passes(large, [], _Nearest(k), "id long, near array<long>")
    large = checkpointed(large.join(near, "id").withColumn("kdist", F.get("near", (F.col("k") - 1).cast("int"))).drop("near", "k"))
    density = _passes(large, ["kdist"], _Reach(), "id long, reach double, w long").select("id", (1 / F.greatest(F.col("reach") / F.col("w"), F.lit(EPSILON))).alias("lrd"))
    large = checkpointed(large.join(density, "id"))
    around = _passes(large, ["kdist", "lrd"], _Around(), "id long, around double, w long").select("id", (F.col("around") / F.col("w")).alias("around"))
    return large.join(around, "id").select("id", (F.col("around") / F.col("lrd")).alias("lof"))


def retained(labelled: DataFrame, limit: float = 1.5, k: int = 3) -> DataFrame:
    """(row_id, label, n, lof, excluded, local): lines with lof >= limit are excluded (in clusters above two); others are numbered by row id, 0 being the cluster's base."""
    scored = lof(labelled, k).withColumn("excluded", (F.col("n") > 2) & (F.col("lof") >= limit))
    return numbered_within(scored, ["label", "excluded"], ["row_id"], "local").withColumn("local", F.when(~F.col("excluded"), F.col("local")))
