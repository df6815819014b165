import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from logweft.llm import line_dedup, simhash_dedup
from logweft.llm.bktree import Trees, union_labels
from logweft.llm.exact_dedup import exact_dedup
from logweft.llm.fm_index import FMIndex
from logweft.llm.line_dedup import dedup_lines
from logweft.llm.mphf import PerfectHash
from logweft.llm.simhash_dedup import near_duplicates
from logweft.llm.substring_dedup import remove_repeats

from .cases import documents, empty, split, texts

BIG = 1 << 62


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rank(i):
    return BIG if i is None else i


def test_exact(spark):
    import re

    rows = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in texts()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = exact_dedup(documents(spark)).collect()
    assert len(got) == len(rows)
    want = sorted((rank(i), rank(min(groups[t], key=rank)), len(groups[t]), sha(t)) for i, t in rows)
    assert sorted((rank(r.doc_id), rank(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = defaultdict(list)
    for r in got:
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
    assert {k: [min(groups[t], key=rank)] for t, k in ((t, sha(t)) for t in groups)} == kept
    assert exact_dedup(empty(spark)).count() == 0


def test_exact_hot_group(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(3000)]
    got = exact_dedup(documents(spark, rows)).collect()
    hot = [r for r in got if r.group_size > 1]
    assert {r.keep_id for r in hot} == {1} and {r.group_size for r in hot} == {2000} and sum(r.kept for r in got) == 1001


def line_brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    holders = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append((rank(i), n if i is None else i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 20 or len({h for h in holders[key(x)]}) < 3 or max(holders[key(x)])[0] == rank(i)]
        out.append((rank(i), len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


@pytest.mark.parametrize("broadcast", [1 << 20, -1])
def test_lines(spark, broadcast):
    docs = documents(spark)
    got = dedup_lines(docs, broadcast_bytes=broadcast, keep=("lang", "kept")).collect()
    assert sorted((rank(r[0]), r[1], r[2], r[3].decode()) for r in got) == line_brute(texts())
    assert any(r[2] for r in got)
    assert dedup_lines(empty(spark), broadcast_bytes=broadcast).count() == 0


@pytest.mark.parametrize("broadcast", [1 << 20, -1])
def test_lines_of_repeated_rows(spark, broadcast):
    two, three, null = (f"a line that {x} documents hold" for x in ("two", "three", "unnamed"))
    rows = [(1, two), (1, f"{two}\nmore"), (1, two), (1, two), (1, two), (2, f"{two}\n{three}"), (3, three), (3, three), (3, three), (4, three), (2, three)]
    rows += [(5, null), (None, f"{null}\n{null}\n{null}")]
    docs = documents(spark, rows).repartition(8)
    assert docs.rdd.glom().filter(lambda x: any(r.doc_id == 1 for r in x)).count() > 1
    got = sorted((rank(r[0]), r[1], r[2], r[3].decode()) for r in dedup_lines(docs, broadcast_bytes=broadcast).collect())
    assert got == line_brute(rows)
    assert sum(r[2] for r in got) == 5


def test_lines_by_groups_of_questions(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUP_BYTES", 512)
    got = dedup_lines(documents(spark).repartition(6), broadcast_bytes=-1).collect()
    assert sorted((rank(r[0]), r[1], r[2], r[3].decode()) for r in got) == line_brute(texts())


def test_line_length_counts_code_points():
    assert line_dedup.line_key("é".encode() * 19, 20) is None
    assert line_dedup.line_key(" É".encode() + b"A" * 19 + b"\r", 20) == "É".encode() + b"a" * 19


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 20000, dtype=np.uint64))
    h = PerfectHash(keys)
    assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash(keys[:0]).index(keys[:3]).tolist() == [-1] * 3


def brute_fingerprint(text):
    w = split((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rows = texts()
    f = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(f)))
    for _ in f:
        for a in range(len(f)):
            for b in range(len(f)):
                if (f[a] ^ f[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for k, (i, _) in zip(label, rows):
        least[k] = min(least.get(k, BIG), rank(i))
    got = near_duplicates(documents(spark)).collect()
    assert sorted((rank(r.doc_id), r.fingerprint, rank(r.component_id)) for r in got) == sorted((rank(i), f"{x:016x}", least[k]) for (i, _), x, k in zip(rows, f, label))
    assert near_duplicates(empty(spark)).count() == 0


def test_bk_trees_find_every_pair():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([points, *[points ^ np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64) for _ in range(8)]]))
    group = rng.integers(0, 3, len(points))
    pairs = {tuple(sorted(p)) for a, b in Trees(group, points).links(4) for p in zip(a.tolist(), b.tolist())}
    want = {(a, b) for a in range(len(points)) for b in range(a + 1, len(points)) if group[a] == group[b] and int(points[a] ^ points[b]).bit_count() <= 4}
    assert pairs == want
    assert union_labels(5, [(np.array([4, 2]), np.array([2, 1]))]).tolist() == [0, 1, 1, 3, 1]


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_links_of_every_number_of_blocks(spark, blocks):
    rng = np.random.default_rng(blocks)
    points = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = [p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False))) for p in points for _ in range(8)]
    points = np.unique(np.concatenate([points, np.array(near, np.uint64)]))
    label = list(range(len(points)))
    for a in range(len(points)):
        for b in range(len(points)):
            if int(points[a] ^ points[b]).bit_count() <= 4 and label[a] != label[b]:
                label = [label[a] if x == label[b] else x for x in label]
    fps = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    got = list(range(len(points)))
    place = {int(x): k for k, x in enumerate(points.view(np.int64))}
    for r in simhash_dedup.links(fps, 4, blocks).collect():
        a, b = got[place[r.u]], got[place[r.v]]
        got = [a if x == b else x for x in got]
    assert [got.index(x) for x in got] == [label.index(x) for x in label]


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash_dedup.best_blocks(n, 4) for n in (0, 10**5, 10**7, 10**11)] == [5, 5, 6, 8]
    assert all(len(simhash_dedup.choices(b, 4)) == math.comb(b, 4) for b in (5, 6, 7, 8))


def test_components_of_a_long_path(spark):
    from logweft.llm.components import components

    edges = spark.range(300).selectExpr("id AS u", "id + 1 AS v").union(spark.range(50).selectExpr("1000L AS u", "id + 2000 AS v"))
    got = dict(components(edges).collect())
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, **{i: 1000 for i in range(2000, 2050)}}
    assert components(edges.where("u < 0")).count() == 0


def test_hot_fingerprints(spark):
    rows = [(i, f"word{i % 7}") for i in range(700)]
    got = simhash_dedup.near_duplicates(documents(spark, rows)).collect()
    assert {r.component_id for r in got} == set(range(7))


def test_substrings(spark):
    rows = texts()
    starts = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            starts[key] = min(starts.get(key, BIG), rank(i))
    want = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if starts[tuple(w[k : k + 13])] < rank(i):
                gone[k : k + 13] = [True] * 13
        want.append((rank(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = remove_repeats(documents(spark)).collect()
    assert sorted((rank(r.doc_id), r.n_words, r.n_removed, r.kept.decode()) for r in got) == sorted(want)
    assert any(r.n_removed for r in got) and all(sum(r.removed_length) == r.n_removed for r in got)
    assert remove_repeats(empty(spark)).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 400)
    text[rng.integers(0, 400, 20)] = 0
    text[-1] = 0
    index = FMIndex(text, 6)
    pattern = rng.integers(0, 6, 300)
    length, row = index.matching_statistics(pattern, np.array([0, 100]), np.array([100, 200]))
    have = [tuple(text[i : i + 6].tolist()) for i in range(400)]

    def longest(p):
        for n in range(min(6, len(p)), 0, -1):
            if all(p[:n]) and any(h[:n] == p[:n] for h in have):
                return n
        return 0

    for k in range(300):
        stop = 100 if k < 100 else 300
        p = tuple(pattern[k:stop].tolist())
        assert length[k] == longest(p), k
        if length[k]:
            at = index.suffixes[row[k]]
            assert tuple(text[at : at + length[k]].tolist()) == p[: length[k]]
