import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweft.llm.hilbert import hilbert_key
from logweft.llm.mixing import fair_queue, mixed_documents
from logweft.llm.packing import pack_documents

from .cases import documents, empty, ordered, split, texts, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def targets(size, weights=(5, 2, 1), share=1.5, repeats=2):
    """Capped shares by resharing the excess again and again."""
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(size.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= repeats * size[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = repeats * size[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def test_mixing(spark):
    docs = documents(spark)
    got = fair_queue(docs).collect()
    assert len(got) == docs.count()
    size = Counter()
    for r in docs.collect():
        size[r.source] += len(split(r.text))
    want, taken = targets(size), Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = fair_queue(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert fair_queue(empty(spark)).count() == 0


def brute_taken(rows, seed=17, repeats=2):
    """Words served of each document, by target and place in its source's shuffled order."""
    import hashlib

    size = Counter()
    for _, s, n in rows:
        size[s] += n
    want, out, at = targets(size), [], Counter()
    for i, s, n in sorted(rows, key=lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest(), r[0], r[2])):
        to = round(want[s])
        out.append((i, s, n, sum(max(0, min(n, to - at[s] - k * size[s])) for k in range(repeats))))
        at[s] += n
    return out


@pytest.mark.parametrize("slices", [4096, 16])
def test_mixing_against_brute_force(spark, monkeypatch, slices):
    from logweft.llm import mixing

    monkeypatch.setattr(mixing, "SLICE", slices)
    rng = np.random.default_rng(4)
    rows = [(k, ["hot", "a", "b", "c", None, "small", "large"][min(6, int(rng.exponential(1.5)))], int(rng.choice([0, 1, 5, 40, 3000], p=[0.1, 0.3, 0.4, 0.19, 0.01]))) for k in range(600)]
    docs = spark.createDataFrame([(i, s, " ".join(["w"] * n)) for i, s, n in rows], "doc_id long, source string, text string").repartition(5)
    got = fair_queue(docs).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((i, t) for i, _, _, t in brute_taken(rows))
    # one source alone gives all it may
    alone = fair_queue(docs.where("source = 'a'")).collect()
    assert abs(sum(r.taken for r in alone) - 1.5 * sum(r.size for r in alone)) <= 1


def test_mixing_without_identifiers(spark):
    docs = spark.createDataFrame([(None, "s", f"text {k} " * (k % 7)) for k in range(300)], "doc_id long, source string, text string")
    got, again = fair_queue(docs).collect(), fair_queue(docs.repartition(3)).collect()
    assert sorted((r.size, r.taken) for r in got) == sorted((r.size, r.taken) for r in again) and abs(sum(r.taken for r in got) - 1.5 * sum(r.size for r in got)) <= 1


def test_mix_of_documents(spark):
    docs = documents(spark)
    mix = mixed_documents(docs)
    assert mix.columns == docs.columns
    words = Counter()
    for r in mix.collect():
        words[r.source] += len(split(r.text))
    want = Counter()
    for r in fair_queue(docs).collect():
        want[r.source] += r.taken
    assert +words == +want
    assert mixed_documents(empty(spark)).count() == 0


def test_hilbert_neighbours():
    n = 16
    points = np.array([(x, y) for x in range(n) for y in range(n)])
    key = hilbert_key(points, 4)
    assert sorted(key.tolist()) == list(range(n * n))
    walk = points[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
    cube = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    assert (np.abs(np.diff(cube[np.argsort(hilbert_key(cube, 3))], axis=0)).sum(1) == 1).all()


def check_packing(pieces, rows, length):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
    for s in sequences.values():
        at = 0
        for offset, size in sorted(s):
            assert offset == at
            at += size
        assert at == length or at < length and at & at - 1 == 0
    assert sum(p.length for p in pieces) == sum(n * len(ids) for (_, ids), n in want.items())
    alone = Counter(i for i, _ in rows)
    for (i, ids), n in want.items():
        if alone[i] == 1:
            mine = sorted(by_doc[i], key=lambda p: p.start)
            assert b"".join(bytes(p.ids) for p in mine) == np.array(ids, "<u4").tobytes()
            assert all(p.doc_tokens == len(ids) for p in mine) and [p.start for p in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))]


def test_packing(spark):
    pieces = pack_documents(documents(spark), PATH, length=256, with_ids=True).collect()
    check_packing(pieces, texts(), 256)
    assert len({p.sequence_id for p in pieces if p.length}) <= sum(p.length for p in pieces) / 256 + 4 * 9
    assert pack_documents(empty(spark), PATH).count() == 0


def test_packing_with_another_tokenizer(spark):
    rows = [(1, "a b  c\n"), (2, None), (3, "It's 10 <|endoftext|> é")]
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = pack_documents(documents(spark, rows), path, with_ids=True).collect()
    got = {i: b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: p.start) if p.doc_id == i) for i, _ in rows}
    for i, t in rows:
        assert got[i] == np.array([*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_word_tokenizer_agrees_on_odd_text():
    import random

    from tokenizers import Tokenizer

    from logweft.llm.packing import WordTokenizer

    rng = random.Random(1)
    letters = [*"abAB zZ\n\t01.,!'|<>-_é ÉßñÜ×÷ſİσΣ—中文😀&", "<|endoftext|>", "it's ", "'ll", "\x00", "\x1c", "\x85", "é"]
    odd = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(500)]
    ids, bounds = WordTokenizer(PATH).encode([t.encode() for t in odd], 1)
    tokenizer = Tokenizer.from_file(PATH)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in odd]


def test_pipeline_stages(spark, tmp_path):
    from .test_dedup import brute_fingerprint, line_brute, rank

    docs = documents(spark, [(k, t) for k, (_, t) in enumerate(texts())])
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        stage(spark, before, "").write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "language_id":
            assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in rows if t and any(c.isalpha() for c in t))
        if name == "line_dedup":
            assert sorted((rank(r.doc_id), r.text) for r in kept.collect()) == sorted((i, t) for i, _, _, t in line_brute(rows))
            assert all(r.n_chars == len(r.text) for r in kept.collect())
        if name == "near_dedup":
            f = {i: brute_fingerprint(t) for i, t in rows}
            least = {i: i for i in f}
            for _ in f:
                for a in f:
                    for b in f:
                        if (f[a] ^ f[b]).bit_count() <= 4:
                            least[a] = least[b] = min(least[a], least[b])
            assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
        if name == "mixing":
            words = Counter()
            for r in kept.collect():
                words[r.source] += len(split(r.text))
            size = Counter()
            for r in before.collect():
                size[r.source] += len(split(r.text))
            assert all(abs(words[s] - x) <= 1 for s, x in targets(size).items())
        if name == "packing":
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(PATH)
            assert sum(r.length for r in kept.collect()) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
        else:
            assert kept.columns == docs.columns
    assert math.isfinite(kept.count()) and ordered([None, 1]) == [1, None]


def test_pipeline_of_odd_tables(spark, tmp_path):
    for rows in ([], [(1, None), (1, ""), (None, None), (2, " \n")], [(7, t) for _, t in texts()[:8]] + [(7, texts()[0][1])]):
        docs = documents(spark, rows) if rows else empty(spark)
        docs.write.parquet(f"{tmp_path}/{len(rows)}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{len(rows)}")
        assert (out.count() > 0) == (len(rows) > 4)
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, "")
            assert kept.columns == docs.columns
    import os

    left = [x for x in os.listdir(out.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0])]
    assert left == ["packing"]


def test_pipeline_without_a_learned_language(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.language_id(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.text for r in got.collect()) == sorted(t for _, t in texts() if t and any(c.isalpha() for c in t))


def test_pipeline_near_dedup_of_rows_that_share_an_identifier(spark):
    a, b, c = (" ".join(words(s, 80)) for s in (1, 2, 3))
    rows = [(1, a), (1, b), (1, b), (2, a), (2, c), (3, c), (3, b), (4, ""), (4, None), (None, a)]
    got = corpus_pipeline.near_dedup(spark, documents(spark, rows).repartition(4), "").collect()
    assert sorted(((r.doc_id, r.text or "") for r in got), key=str) == sorted([(1, a), (1, b), (2, c), (4, ""), (None, a)], key=str)
