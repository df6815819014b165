import math
import zlib
from collections import Counter

import numpy as np
import pytest

from logweft.llm import language_id, lm_scoring
from logweft.llm.html_extraction import blocks, common, differ, extract_text
from logweft.llm.lm_scoring import score_documents
from logweft.llm.topk_search import top_k

from .cases import documents, empty, split, texts

TEST_DATA = "/root/testdata/sf0.001"


def test_language_edges(spark):
    model = language_id.train(documents(spark), ~language_id.held_out())
    got = language_id.identify(documents(spark), model).select("doc_id", "text", "lang_pred", "score").collect()
    assert len(got) == len(texts())
    for r in got:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr") and 0 <= r.score <= 1
    assert language_id.identify(empty(spark), model).count() == 0
    nothing = language_id.train(empty(spark), ~language_id.held_out())
    assert {r.lang_pred for r in language_id.identify(documents(spark), nothing).collect()} == {"und"}


def brute_scores(train, text):
    """Naive Bayes from its definition: hashed 1- to 3-grams that begin in a text, which two blanks follow."""

    def grams(t):
        codes = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) if "a" <= c <= "z" or ord(c) > 127 else 32 for c in t] + [32] * 3
        for n in language_id.ORDERS:
            for k in range(len(t)):
                h = n * 0x9E3779B1 & 0xFFFFFFFF
                for x in codes[k : k + n]:
                    h = (h ^ x) * 0x85EBCA6B & 0xFFFFFFFF
                    h ^= h >> 15
                yield (h * 0xC2B2AE35 & 0xFFFFFFFF) >> 32 - language_id.BITS

    counts, rows = {}, Counter()
    for t, lang in train:
        rows[lang] += 1
        counts.setdefault(lang, Counter()).update(grams(t))
    log = {}
    for lang, c in counts.items():
        total = sum(c.values()) + language_id.SMOOTHING * 2**language_id.BITS
        log[lang] = math.log(rows[lang] / sum(rows.values())) + sum(math.log((c[g] + language_id.SMOOTHING) / total) for g in grams(text))
    best = max(sorted(log), key=log.get)
    return best, 1 / sum(math.exp(x - log[best]) for x in log.values())


def test_language_against_brute_force(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("A thing of THE past", "en"), ("le chat et le chien", "fr"), ("élan vital, été", "fr"), ("die Katze und der Hund", "de"), ("the", None)] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [(t, lang) for k, t, lang in rows if lang and zlib.crc32(str(k).encode()) % 3 != 1]
    model = language_id.train(docs, ~language_id.held_out())
    asked = ["the dog", "chat", "und", "É", "x" * 200 + " the", "le the die"]
    got = language_id.identify(spark.createDataFrame([(t,) for t in asked], "text string"), model).collect()
    for r in got:
        lang, score = brute_scores(train, r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-3)


def test_language_needs_a_letter():
    assert [language_id.has_letter(t) for t in ("½ ² ①", "12 _ !", "ª", "中", "ⅷ", "x", "")] == [False, False, True, True, False, True, False]


def test_language_bound(spark):
    docs = spark.createDataFrame([(k, "some words", f"l{k % 9}") for k in range(90)] + [(100, "some words", "l5")], "doc_id long, text string, lang string")
    assert language_id.train(docs, docs.doc_id.isNotNull(), most_languages=3).languages == ["l0", "l1", "l5"]


def test_language_prediction_does_not_depend_on_neighbours():
    model = language_id.Model({"x": np.bincount(language_id._features(["aaa bbb"])[0][2], minlength=1 << language_id.BITS), "y": np.ones(1 << language_id.BITS, int)}, {"x": 1, "y": 1})
    texts = ["aaa", "é b", "", None, "zzz aaa"]
    together = model.predict(texts)
    apart = [model.predict([t]) for t in texts]
    assert together[0] == [a[0][0] for a in apart] and np.allclose(together[1], [a[1][0] for a in apart])


def test_language_priors_are_of_all_rows(spark):
    rows = [(k, "the same words", "en" if k % 10 else "fr") for k in range(2000)] + [(-1, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, docs.doc_id.isNotNull(), per_language=100)
    assert model.languages == ["en", "fr"] and np.allclose(np.exp(model.prior), [0.9, 0.1])


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TEST_DATA}/documents.parquet")
    model = language_id.train(docs, ~language_id.held_out())
    rows = language_id.identify(docs, model).where(language_id.held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def lm_brute(rows):
    lower = {i: i + 32 for i in range(65, 91)}
    tokens = [[*split((t or "").translate(lower)), None] for _, t in rows]
    learned = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    c = Counter(x for t, k in zip(tokens, learned) if k for x in t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for t in tokens]


def test_lm(spark):
    got = score_documents(documents(spark)).collect()
    want = sorted(lm_brute(texts()))
    for a, b in zip(sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), want):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])
    assert all(r.score < 0 for r in got)
    assert score_documents(empty(spark)).count() == 0


def brute_lm_scores(rows):
    """log10 probability of each text by the mixture's definition, counts and expectation-maximisation written out in plain Python."""
    tokens = [[*split((t or "").translate({i: i + 32 for i in range(65, 91)})), None] for _, t in rows]
    learned = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    deleted = [k and zlib.crc32(f"{i}/deleted".encode()) % 10 == 0 for k, (i, _) in zip(learned, rows)]
    bucket = lambda n: 0 if n == 0 else min(n.bit_length(), lm_scoring.BUCKETS - 1)

    def counted(which):
        word, pair = Counter(), Counter()
        for t, k in zip(tokens, which):
            if k:
                word.update(t)
                pair.update(zip(["start", *t], t))
        return word, pair, sum(which), sum(word.values())

    def estimates(t, word, pair, documents, total):
        for before, x in zip(["start", *t], t):
            context = documents if before == "start" else word[before]
            yield bucket(context), pair[before, x] / context if context else 0.0, word[x] / total

    word, pair, documents, total = counted([k and not d for k, d in zip(learned, deleted)])
    binned = lambda p: 2.0 ** (max(round(4 * math.log2(p)), 1 - 160) / 4) if p > 0 else 0.0
    held = [(b, binned(two), binned(one)) for t, d in zip(tokens, deleted) if d for b, two, one in estimates(t, word, pair, documents, total)]
    uniform = 1 / (len(word) + 1)
    weights = {b: (0.4, 0.5, 0.1) for b in range(lm_scoring.BUCKETS)}
    for _ in range(60 if held else 0):
        share = {b: [0.01] * 3 for b in weights}
        for b, two, one in held:
            parts = [w * p for w, p in zip(weights[b], (two, one, uniform))]
            for k in range(3):
                share[b][k] += parts[k] / sum(parts)
        weights = {b: tuple(x / sum(v) for x in v) for b, v in share.items()}
    weights[0] = (0.0, *(x / sum(weights[0][1:]) for x in weights[0][1:]))
    word, pair, documents, total = counted(learned)
    return [sum(math.log10(sum(w * p for w, p in zip(weights[b], (two, one, 1 / (len(word) + 1))))) for b, two, one in estimates(t, word, pair, documents, total)) for t in tokens]


def test_lm_scores_against_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"w{int(x)}" for x in rng.zipf(1.4, 4000) if x < 300]
    rows = [(k, " ".join(words[rng.integers(0, len(words) - 40) :][: rng.integers(0, 40)])) for k in range(160)] + [(500, None), (None, "w1 w2 zzz"), (501, "unseen words w1")]
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = sorted((i is None, i or 0, s) for (i, _), s in zip(rows, brute_lm_scores(rows)))
    for r, (_, i, s) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), want):
        assert (r.doc_id or 0) == i and r.score == pytest.approx(s, rel=1e-6), i


def test_lm_without_training_text(spark):
    got = score_documents(documents(spark, [(None, "a b"), (None, None)])).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_lm_is_better_on_held_out_text(spark):
    rows = score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_em_finds_the_mixture():
    rng = np.random.default_rng(0)
    # tokens of one bucket: bigram estimate 0 or 1/2, unigram 1/1024; seven in ten come from bigrams
    cells = {}
    cell = lambda two, one: (5 * lm_scoring._BINS + int(lm_scoring._bin(np.array([two]))[0])) * lm_scoring._BINS + int(lm_scoring._bin(np.array([one]))[0])
    cells[cell(0.5, 2.0**-10)] = 70000
    cells[cell(0.0, 2.0**-10)] = 29000 + int(rng.integers(10))
    cells[cell(0.0, 0.0)] = 1000
    w = lm_scoring.learn_weights(cells, 10**6)[5]
    assert w.sum() == pytest.approx(1) and w[0] == pytest.approx(0.7, abs=0.01) and w[2] == pytest.approx(0.01, abs=0.002)


def test_mixture_is_a_distribution(spark):
    """The probabilities of all known tokens and one unknown token after a context add up to 1."""
    weights = lm_scoring.learn_weights({}, 0)
    pair, context, word, total = np.array([3, 2, 0, 0]), 5, np.array([4, 3, 2, 1]), 10
    p = weights[3] @ np.stack([pair / context, word / total, np.full(4, 1 / 5)]) + 0
    assert p.sum() + weights[3][2] / 5 == pytest.approx(1)


def brute_topk(rows, k=20):
    from fractions import Fraction

    ok = [(i, [math.floor(Fraction(float(e)) * 64) for e in v]) for i, v in rows if i is not None and v is not None and all(e is not None and math.isfinite(e) for e in v)]
    out = []
    for i, q in ok:
        if i % 20 == 0:
            scored = [(min(max(sum(a * b for a, b in zip(q, v)), -(1 << 63)), (1 << 63) - 1), j) for j, v in ok if j != i]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32).round(1)
    x[50:60] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [None] * 8), (1040, [float("nan")] * 8), (1060, [1.0] * 7), (1061, [0.5] * 11), (1062, []), (None, [1.0] * 8), (1080, [float("inf")] * 8), (1100, []), (20, [-1.0] * 8), (7, [2.0] * 3)]
    frame = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<float>")
    got = top_k(frame(rows).repartition(3), _every20(), k=20).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows)
    few = top_k(frame(rows[:5]), _every20(), k=20)
    assert few.count() == 4
    assert top_k(frame([]), _every20()).count() == 0


def test_topk_of_large_components(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-3, 10)).tolist()) for i in range(120)]
    rows += [(200, [1e17, -1.0, 3.0, 0.0]), (201, [-1e17, 2.0, 1.0, 5.0]), (220, [1e300, 1.0, 1.0, 1.0]), (221, [1e308, -1.0, 0.0, 0.0]), (222, [2.0**31, 2.0**33, 1.0, 1.0]), (240, [-1.7e308, 1.0, 0.0, 0.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2), _every20(), k=9).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows, 9)


def test_topk_over_several_runs(spark, monkeypatch):
    from logweft.llm import topk_search

    for name, value in {"RUN_BYTES": 8000, "MESSAGE_BYTES": 1000, "QUERY_ROWS": 3, "SAMPLE_ROWS": 25}.items():
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 3, 8).astype(float).tolist()) for i in range(400)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), _every20(), k=20).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows)


def _every20():
    from pyspark.sql import functions as F

    return F.col("vec_id") % 20 == 0


def test_html_blocks():
    page = """<!DOCTYPE html><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use</div>
    <div class="content"><p class=ad>Buy<p>Real text &lt;b&gt; a<br>b&nbsp;c</p><ul><li>one<li>two</ul></div>
    <section class="comments"><article class="comment"><p>hi</p></article></section><form><input>x</form><p>tail <b>bold</b>er <"""
    assert [t for t, _ in blocks(page)] == ["Real text <b> a b c", "one", "two", "tail bolder <"]
    page = "<nav>n</nav><article><h1>T</h1><script>var a='</p>'</script><p>a &amp; b<p>c<aside>no</aside><div role=complementary>no</div><!-- x --> d</article><footer>f</footer>"
    assert blocks(page) == [("T", True), ("a & b", True), ("c", True), ("d", True)]
    assert blocks("") == [] and blocks("plain\n text") == [("plain text", False)] and blocks("<p>cut off <a href='x") == [("cut off", False)]


def test_html_articles_and_marks():
    text = lambda html: [t for t, _ in blocks(html)]
    assert text('<article class="post has-comments"><p>Main text here</article><div class="comments">x</div>') == ["Main text here"]
    assert blocks("<main><p>The real body text.</p><article>teaser</article></main>") == [("The real body text.", True), ("teaser", True)]
    assert text('<div class="content has-sidebar"><p>a</p><div class="sidebar">b</div></div>') == ["a"]
    assert text('<div class="nav-open"><nav>n</nav><article>a</article><div class="notice">x</div></div><p>tail') == ["a", "tail"]
    assert text('<div class="sidebar"><article>teaser</article></div><article>a</article>') == ["a"]
    assert text('<section class="comments"><article class="comment">c</article></section>') == [] == text('<article class="comment">c</article>')
    assert text('<form><div class="page"><article>a<form>x</form></article></div><input></form>') == ["a"] and text("<form><p>all there is</form>") == ["all there is"]
    assert text('<p class="related-work">r</p><p>a <span class="comment"># b</span> <math><mi>x</mi></math></p><noscript>n</noscript><p hidden>h</p>') == ["r", "a # b x", "n", "h"]
    assert text("<menu><li>site</menu><article><menu><li>one<li>two</menu></article>") == ["one", "two"]
    assert text('<div class="ad">Buy<p>a</p>') == [] and text('<div class="ad">Buy<article>a</article>') == ["Buy", "a"]


def brute_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    out, j = [False] * len(a), len(b)
    for i in range(len(a), 0, -1):
        if best[i][j] > best[i - 1][j]:
            out[i - 1] = True
            while best[i][j - 1] == best[i][j]:
                j -= 1
            j -= 1
    return out


def test_common_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = (rng.integers(0, rng.integers(1, 8), rng.integers(0, 40)).tolist() for _ in range(2))
        assert common(a, b) == brute_common(a, b), (a, b)
    assert sum(common(["x"] * 20000, ["x"] * 9999 + ["y"] + ["x"] * 5000)) == 14999


def test_differencing():
    a, b = list("abcbdab"), list("bdcaba")
    kept = [x for x, k in zip(a, common(a, b)) if k]
    assert len(kept) == 4 and common([], b) == [] and not any(common(a, []))
    page, other = [("menu", False), ("own", False), ("end", False)], [("menu", False), ("other", False), ("end", False)]
    assert differ(page, other) == ["own"] and differ(page, page) == ["menu", "own", "end"] and differ(page, None) == ["menu", "own", "end"]


def brute_extract(rows):
    """Text of each page by the method's definition, over all pages at once: rows (page_id, url, html)."""
    import re as r

    pages = []
    for i, url, html in rows:
        host = r.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        path = r.match(r"(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", url or "")[1]
        page = blocks(html or "")
        pages.append(((host[1] if host else "").lower(), path, (i is None, i or 0), [t for t, _ in page], page, i))
    pages.sort(key=lambda p: (p[0].encode(), p[1].encode(), p[2]))
    # lines of articles on many unlike pages of a host: pages differ by their longest other line
    on, of = {}, {}
    for host, _, _, _, page, _ in pages:
        own = sorted({t for t, mine in page if mine}, key=lambda t: (-len(t), t))
        if host and own:
            of.setdefault(host, set()).add((own[0], own[:2][-1]))
            for t in own:
                on.setdefault((host, t), set()).add(own[0] if t != own[0] else own[:2][-1])
    site = {k for k, v in on.items() if len(v) >= 5 and 2 * len(v) >= len(of[k[0]])}
    near = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    out = {}
    for k, (host, path, _, lines, page, i) in enumerate(pages):
        a = b = k
        while a >= 0 and (pages[a][0], pages[a][3]) == (host, lines):
            a -= 1
        while b < len(pages) and (pages[b][0], pages[b][3]) == (host, lines):
            b += 1
        options = [(near(pages[o][1].split("/"), pages[e][1].split("/")), -n, pages[o][3]) for n, (o, e) in enumerate(((a, a + 1), (b, b - 1))) if 0 <= o < len(pages) and pages[o][0] == host and host]
        shared = brute_common(lines, max(options)[2]) if options else []
        if all(shared):
            stay = [mine for _, mine in page] if any(mine for _, mine in page) else [True] * len(page)
        else:
            stay = [not x or mine and (host, t) not in site for (t, mine), x in zip(page, shared)]
        out.setdefault(i, []).append("\n".join(t for t, x in zip(lines, stay) if x))
    return out


@pytest.mark.parametrize("parts", [1, 4, 25, 64])
def test_extract_against_brute_force(spark, parts):
    rng = np.random.default_rng(9)
    line = lambda n: f"<p>line {rng.integers(n)} of the text</p>"
    rows = []
    for k in range(150):
        host, menu = f"h{k % 4}.x", "".join(f"<div>menu {j}</div>" for j in range(k % 4 + 1))
        body = "".join(line(30) for _ in range(rng.integers(0, 6)))
        notice = "<p>A notice of the site</p>" if k % 4 == 1 else ""
        html = f"<article><h1>Page {k}</h1>{notice}{body}</article>{menu}" if k % 4 < 2 else f"{menu}{body}<div>end</div>" if k % 3 else f"{menu}<div>a copy</div>"
        rows.append((k, f"http://{host}/{'abc'[k % 3]}/{rng.integers(9)}/{k % 7}", html))
    rows += [(200, None, "<p>x"), (None, "http://h2.x/a/1", "<p>menu 0"), (None, "http://h2.x/a/2", ""), (201, "http://h2.x/zz", None)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {}
        for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect():
            got.setdefault(r.page_id, []).append(r.text)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = brute_extract(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_extract(spark):
    page = lambda t: f"<div>Menu line</div><p>{t}</p><div>End line</div>"
    rows = [(1, "http://h.x/a/1", page("one")), (2, "http://h.x/a/2", page("two")), (3, "http://H.x/b?q", page("three")), (4, None, page("four")), (5, "http://h.x/c", None), (6, "x", ""), (None, "http://z/", page("five")), (7, "http://h.x/a/1", page("one"))]
    schema = "page_id long, url string, html string, text string, host string, path string, body string"
    got = {r.page_id: r for r in extract_text(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema).coalesce(1)).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert got[5].text == got[6].text == "" and got[4].text == "Menu line\nfour\nEnd line"
    assert extract_text(spark.createDataFrame([], schema)).count() == 0


def test_differencing_of_articles(spark):
    notice, menu = "This site uses a notice line", "<div>Unmarked menu line</div>"
    body = lambda k: "".join(f"<p>{w} {k}, a line of its own</p>" for w in ("one", "two"))
    page = lambda k, more="": f"{menu}<article><h1>Page {k}</h1><p>{notice}</p>{body(k)}{more}</article><div>Lines outside of {k}</div>"
    quoted = "<p>A passage that two pages of the site quote</p>"
    rows = [(k, f"http://h.x/a/{k}", page(k, quoted if k in (2, 3) else "")) for k in range(8)]
    rows += [(20 + k, f"http://copies.x/a/{k}", f"<article><h1>Day {k}</h1>{body('copy')}</article>") for k in range(8)]
    rows += [(40, "http://alone.x/", page("alone"))]
    got = {r.page_id: r.text.split("\n") for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    for k in range(8):
        own = [f"Page {k}", f"one {k}, a line of its own", f"two {k}, a line of its own"]
        assert got[k] == own + ["A passage that two pages of the site quote"] * (k in (2, 3)) + [f"Lines outside of {k}"]
        assert got[20 + k] == [f"Day {k}", "one copy, a line of its own", "two copy, a line of its own"]
    assert got[40] == ["Page alone", notice, "one alone, a line of its own", "two alone, a line of its own"]


@pytest.mark.parametrize("parts", ["1", "4", "11"])
def test_differencing_past_copies_and_edges(spark, parts):
    page = lambda t: f"<div>Menu line</div><p>{t}</p><div>End line</div>"
    # runs of 1, 2, 3 and 30 copies on one host, so that edges cut runs and lie between them
    copies = [1, 3, 30, 1, 2, 3, 1, 1]
    words = [f"word {k}" for k, n in enumerate(copies) for _ in range(n)]
    rows = [(k, f"http://h.x/a/{k:03}", page(w)) for k, w in enumerate(words)]
    rows += [(100 + k, f"http://same.x/{k}", page("same")) for k in range(12)] + [(200, "http://alone.x/", page("alone"))]
    # one path and no identifiers
    rows += [(None, "http://null.x/", page(w)) for w in ("x", "y", "y", "y")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = extract_text(spark.createDataFrame(rows[::-1], "page_id long, url string, html string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by = {r.page_id: r.text for r in got if r.page_id is not None}
    assert len(got) == len(rows) and [by[k] for k in range(len(words))] == words
    assert {by[100 + k] for k in range(12)} == {"Menu line\nsame\nEnd line"} and by[200] == "Menu line\nalone\nEnd line"
    assert sorted(r.text for r in got if r.page_id is None) == ["x", "y", "y", "y"]
