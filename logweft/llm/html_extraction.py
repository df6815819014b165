"""Main text of web pages by differencing pages with near URLs.

A page becomes blocks of text: markup, scripts, styles and forms go; elements
that say what they are (nav, aside, footer, class="comments", role="banner",
...) go with all they hold, unless that is the page's whole article.  Then pages are range-sorted by host, URL path and
identifier, each page is paired with the neighbour on its host whose path is
nearest, the two pages' lines are aligned by longest common subsequence, and
shared lines are deleted, unless all lines of a page are shared, as between
copies.

Copies and quoted passages share true text, so a shared line inside an element
that the page itself marks as its article (or main part) is deleted only if the
line is the site's: on MANY unlike pages of the host at least, and on half of
the host's unlike pages.  Pages are unlike, with regard to a line, where their
longest other lines differ; copies and pages around one long quotation count
once.  A host's unlike pages differ in one of their two longest lines.  These
lines are counted before pages are paired, and their hashes are broadcast.  A
page without a partner has its article for text, where it has one.

Equal pages in a row are one run with one partner: the last page before or the
first page after the run, whichever path is nearer to the run's own end there.
The sort key ends with the identifier, so a host of any size spreads over
partitions.  Their bounds are drawn from a sample of the keys; a first pass
over hashes of lines finds the runs at the partitions' edges, so a run that an
edge cuts, or that lies at one, has the partner that it would have without.

Defined cases: null or empty html gives an empty text; a null url is a host of
its own; null identifiers sort last; unclosed elements end where HTML ends them
or with the page; a tag that the page's end cuts off is dropped; an empty table
gives an empty result.
"""
from __future__ import annotations

import pickle
import re
from bisect import bisect_right
from html import unescape
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed, partitions
from .words import NO_ID, column_ids, ids_column, sliced

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/!?][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")

# fixed values: HTML element names and the names by which pages mark their parts
RAW = frozenset("script style template iframe textarea title noembed noframes".split())
DROPPED = frozenset("nav footer aside form button select dialog head search datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mover mroot mrow msqrt mstyle msub msubsup msup mtext munder q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
SELF_CLOSING = frozenset("p li dt dd option tr td th".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
ADVERTS = frozenset("ad ads adbox adsense advert adverts advertisement advertisements advertorial sponsor sponsored promo promotion promotions banner banners".split())
MARKS = COMMENTS | ADVERTS | frozenset(
    "cookie cookies cookiebar consent gdpr notice notices notification notifications popup modal overlay lightbox newsletter subscribe subscription signup login paywall "
    "sidebar aside nav navbar navigation menu menus menubar breadcrumb breadcrumbs pagination pager toolbar footer masthead topbar".split()
)
#: words that make a state of what follows: an element that has a sidebar is none
HAVING = frozenset("has have having with without no not non is hide show enable disable".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: unlike pages of a host that a line of articles is on at least before it can be the site's
MANY = 5
NEVER = frozenset("html body h1 h2 h3 h4 h5 h6".split())
_PARTS = re.compile(r"<(article|main)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-z][^>]*\b(?:role\s*=\s*[\"']?(?:main|article)\b|itemprop\s*=\s*[\"']?articleBody\b)", re.I)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\t\n\r\f") else {}


def _words(at: dict[str, str]):
    """Words of each class and identifier of an element."""
    for k in ("class", "id"):
        for name in at.get(k, "").split():
            if found := [x.lower() for x in _NAMES.split(name) if x]:
                yield found


def _mark(at: dict[str, str], inside: bool) -> str:
    """The word by which an element's names say that it is not part of the text: the first or last of a name, not behind a word of having."""
    for words in _words(at):
        for k in {0, len(words) - 1}:
            if (words[k] in MARKS or words[k] == "header" and not inside) and not HAVING.intersection(words[:k]):
                return words[k]
    return ""


def _of_readers(at: dict[str, str]) -> bool:
    """Whether an article says that it is a comment or an advert."""
    return any(words[0] in COMMENTS or words[0] in ADVERTS for words in _words(at))


def _is_article(tag: str, at: dict[str, str]) -> bool:
    return tag in ("article", "main") or at.get("role", "").lower() in ("main", "article") or at.get("itemprop") == "articleBody"


def blocks(html: str, forms: bool = False) -> list[tuple[str, bool]]:
    """(text, whether it is in what the page marks as its article or main part) of the blocks of a page.

    An element that goes for its names, or as a form, stays if the page's whole
    article is inside it; reader comments go whatever they hold.  A page of
    which nothing is left is read again with its forms.
    """
    found: list[tuple[str, bool]] = []
    held: list[str] = []
    # open articles and main parts: (tag, depth of the tag)
    articles: list[tuple[str, int]] = []
    depth: dict[str, int] = {}
    gone, gone_depth, gone_from, spared = "", 0, 0, False
    place = 0
    parts: list[int] | None = None

    def close():
        if held:
            if text := " ".join(unescape("".join(held)).split()):
                found.append((text, bool(articles)))
            held.clear()

    def whole_article(a: int, b: int) -> bool:
        nonlocal parts
        if parts is None:
            parts = [m.start() for m in _PARTS.finditer(html) if not _of_readers(_attributes(m[2] or ""))]
        return bool(parts) and a <= parts[0] and parts[-1] < b

    def opened(tag: str):
        if articles:
            depth[tag] = depth.get(tag, 0) + 1

    tokens = _TOKEN.finditer(html)
    while True:
        m = next(tokens, None)
        if m is None:
            if gone and spared and whole_article(gone_from, len(html)):
                opened(gone)
                gone, place = "", gone_from
                tokens = _TOKEN.finditer(html, place)
                continue
            break
        if m.start() < place:
            continue
        if not gone and m.start() > place:
            held.append(html[place : m.start()])
        place = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        end = bool(m[1])
        if gone:
            if tag == gone and (end or tag not in SELF_CLOSING):
                gone_depth += -1 if end else 1
                if gone_depth > 0:
                    continue
                if spared and whole_article(gone_from, m.start()):
                    opened(gone)
                    place = gone_from
                    tokens = _TOKEN.finditer(html, place)
                gone = ""
                continue
            if not end and tag in RAW:
                stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, place)
                place = stop.end() if stop else len(html)
                continue
            if gone not in SELF_CLOSING or tag in INLINE:
                continue
            gone = ""  # a paragraph that its next sibling or its parent's end closes
        if not end and tag in RAW:
            if m[0].endswith("/>") and tag == "iframe":
                continue
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, place)
            place = stop.end() if stop else len(html)
            close()
            continue
        if tag not in INLINE:
            close()
        elif tag == "br":
            held.append(" ")
        if tag in VOID:
            continue
        if end:
            if depth.get(tag, 0):
                if articles[-1] == (tag, depth[tag]):
                    articles.pop()
                depth[tag] -= 1
                if not articles:
                    depth.clear()
            continue
        at = _attributes(m[3] or "")
        article = _is_article(tag, at)
        if article:
            drop, spared = _of_readers(at), False
        else:
            mark = _mark(at, bool(articles)) if at and tag not in NEVER and tag not in INLINE else ""
            form = tag == "form" and not forms
            drop = mark or form or tag in DROPPED and tag != "form" or tag in ("header", "menu") and not articles or at.get("role", "").lower() in ROLES
            spared = bool(mark) and mark not in COMMENTS or form
        if drop:
            close()
            gone, gone_depth, gone_from = tag, 1, place
            continue
        if article:
            depth[tag] = depth.get(tag, 0) + 1
            articles.append((tag, depth[tag]))
        else:
            opened(tag)
    if not gone and place < len(html):
        held.append(html[place:])
    close()
    if not found and not forms and "<form" in html.lower():
        return blocks(html, True)
    return found


def common(a: list, b: list) -> list[bool]:
    """For each of a, whether it is in a longest common subsequence of a and b; of several, the one that from the end leaves out what it can of a.

    Rows of the programme are bit vectors (Hyyro 2004), a word a 64 columns, so
    equal lines cost no more than others; of n rows about 2 sqrt(n) are held,
    the others are made again on the way back.
    """
    out = [False] * len(a)
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        out[first] = True
        first += 1
    here, there = set(a[first:]), set(b[first:])
    rows = [i for i in range(first, len(a)) if a[i] in there]
    columns = [x for x in b[first:] if x in here]
    if not rows:
        return out
    where: dict = {}
    for j, x in enumerate(columns):
        where.setdefault(x, []).append(j)
    kept: dict = {}

    def mask(x) -> int:
        if x not in kept:
            bits = 0
            for j in where[x]:
                bits |= 1 << j
            if len(where[x]) <= 64:
                return bits
            kept[x] = bits
        return kept[x]

    full = (1 << len(columns)) - 1

    def step(v: int, i: int) -> int:
        u = v & mask(a[rows[i]])
        return ((v + u) | (v - u)) & full

    size = max(1, isqrt(len(rows)))
    starts, v = [], full
    for i in range(len(rows)):
        if i % size == 0:
            starts.append(v)
        v = step(v, i)
    j = len(columns)
    for k in range(len(starts) - 1, -1, -1):
        chain = [starts[k]]
        for i in range(k * size, min(len(rows), (k + 1) * size)):
            chain.append(step(chain[-1], i))
        for i in range(len(chain) - 1, 0, -1):
            below = (1 << j) - 1
            if ((chain[i] ^ chain[i - 1]) & below) and (chain[i] & below).bit_count() < (chain[i - 1] & below).bit_count():
                out[rows[k * size + i - 1]] = True
                j = (~chain[i] & below).bit_length() - 1
    return out


def _stay(lines: list, own: list[bool], other: list | None, often) -> list[bool]:
    """For each line of a page, whether it is text of its own; of the article only lines go that are in `often`."""
    shared = common(lines, other) if other else []
    if all(shared):
        return own if any(own) else [True] * len(lines)
    return [not s or mine and t not in often for t, mine, s in zip(lines, own, shared)]


def differ(page: list[tuple[str, bool]], other: list[tuple[str, bool]] | None, often=frozenset()) -> list[str]:
    """Lines of page without those shared with other; of its article only those go that are in `often`."""
    stay = _stay([t for t, _ in page], [own for _, own in page], [t for t, _ in other or ()], often)
    return [t for (t, _), s in zip(page, stay) if s]


def _line_key(host: str, line: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{host}\n{line}".encode("utf-8", "surrogatepass"))


def _digest(keys: list[int]) -> bytes:
    return xxhash.xxh3_128_digest(np.array(keys, np.uint64).tobytes())


def _part(bounds: list[tuple], host: str, path: str, i: int) -> int:
    return bisect_right(bounds, (host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass"), i))


_OUTLINE = "part int, page_id long, host string, path string, digest binary, keys binary, own binary, longest binary"


def _outline(batches, bounds: list[tuple]):
    """Pages with the keys of their lines in the lines' place."""
    for batch in sliced(batches, 4):
        out = []
        for i, host, path, html in zip(column_ids(batch.column(0)).tolist(), *[batch.column(k).to_pylist() for k in (2, 3, 4)]):
            page = blocks(html or "")
            keys = [_line_key(host, t) for t, _ in page]
            longest = [_line_key(host, t) for t in sorted({t for t, own in page if own}, key=lambda t: (-len(t), t))[:2]]
            out.append((_part(bounds, host, path, i), _digest(keys), np.array(keys, np.uint64).tobytes(), bytes(own for _, own in page), np.array(longest, np.uint64).tobytes()))
        part, *rest = zip(*out) if out else [()] * 5
        digest, keys, own, longest = (pa.array(x, pa.binary()) for x in rest)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0), batch.column(2), batch.column(3), digest, keys, own, longest], names=["part", "page_id", "host", "path", "digest", "keys", "own", "longest"])


_LINES = pa.schema([("h", pa.int64()), ("k", pa.int64()), ("page", pa.int64())])


def _lines(batches):
    """(host, line, what tells the page from others) of articles' lines; a row with line = host for each page."""
    for batch in batches:
        rows: set[tuple[int, int, int]] = set()
        for host, keys, own, longest in zip(*[c.to_pylist() for c in batch.columns]):
            if host and longest:
                h, long = _line_key(host, ""), np.frombuffer(longest, np.uint64).tolist()
                rows.add((h, h, _line_key(host, f"{long[0]} {long[-1]}")))  # so a host has no fewer pages than one of its lines
                rows.update((h, k, long[0] if k != long[0] else long[-1]) for k, mine in zip(np.frombuffer(keys, np.uint64).tolist(), own) if mine)
        table = np.array(list(rows), np.uint64).reshape(-1, 3).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(table[:, k])) for k in range(3)], schema=_LINES)


def site_lines(outline: DataFrame) -> np.ndarray:
    """Sorted keys of the articles' lines that are their sites' own."""
    counts = outline.select("host", "keys", "own", "longest").mapInArrow(_lines, "h long, k long, page long").groupBy("h", "k").agg(F.count_distinct("page").alias("n"))
    often = checkpointed(counts.where(F.col("n") >= MANY))
    pages = often.where("h = k").select("h", F.col("n").alias("pages"))
    found = often.where("h <> k").join(pages, "h").where("2 * n >= pages").select("k").toArrow()
    return np.sort(found.column("k").to_numpy().view(np.uint64))


def _nearness(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Run:
    """Equal pages in a row: host, digest and keys of their lines, and the paths of the first and the last."""

    def __init__(self, host: str, digest: bytes, keys: list[int], first: str, last: str):
        self.host, self.digest, self.keys, self.first, self.last = host, digest, keys, first, last
        self.pages: list[tuple] = []

    def joins(self, other) -> bool:
        return self.host == other.host and self.digest == other.digest

    def partner(self, before, after) -> list[int] | None:
        """Lines of the nearer of the runs before and after; the one before wins ties."""
        near = [(_nearness(x.split("/"), y.split("/")), r.keys) for r, x, y in ((before, before and before.last, self.first), (after, self.last, after and after.first)) if r is not None and r.host == self.host and self.host]
        return max(near, key=lambda x: x[0])[1] if near else None


def _edges(batches):
    """The first two and last two runs of each partition (all of them where it has fewer), in order."""
    head: list[_Run] = []
    tail: list[_Run] = []
    at = None

    def flush():
        runs = head + [r for r in tail if not any(r is x for x in head)]
        found = [(r.host, r.digest, r.keys, r.first, r.last) for r in runs]
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([pickle.dumps(found)], pa.binary())], names=["part", "runs"])

    for batch in batches:
        for part, host, path, digest, keys in zip(*[c.to_pylist() for c in batch.columns]):
            if at is not None and part != at:
                yield flush()
                head, tail = [], []
            at = part
            if tail and tail[-1].host == host and tail[-1].digest == digest:
                tail[-1].last = path
                continue
            tail = [*tail[-1:], _Run(host, digest, np.frombuffer(keys, np.uint64).tolist(), path, path)]
            if len(head) < 2:
                head.append(tail[-1])
    if at is not None:
        yield flush()


def _contexts(edges: list[tuple[int, list]]) -> dict[int, tuple]:
    """For each partition: run before its first run, first path of that run, last path of its last run, run after that.

    Runs that an edge cuts are joined, so the runs before and after may be partitions away.
    """
    chain: list[_Run] = []
    ends = {}
    for part, runs in sorted(edges):
        places = []
        for r in (_Run(*x) for x in runs):
            if chain and not places and chain[-1].joins(r):
                chain[-1].last = r.last
            else:
                chain.append(r)
            places.append(len(chain) - 1)
        ends[part] = places[0], places[-1]
    return {p: (chain[a - 1] if a else None, chain[a].first, chain[b].last, chain[b + 1] if b + 1 < len(chain) else None) for p, (a, b) in ends.items()}


def _parse(batches, bounds: list[tuple]):
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in sliced(batches, 4):
        part, digest, body = [], [], []
        for i, host, path, html in zip(column_ids(batch.column(0)).tolist(), *[batch.column(k).to_pylist() for k in (2, 3, 4)]):
            page = blocks(html or "")
            part.append(_part(bounds, host, path, i))
            digest.append(_digest([_line_key(host, t) for t, _ in page]))
            body.append(squeeze(pickle.dumps(page, protocol=5)))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns[:4], pa.array(digest, pa.binary()), pa.array(body, pa.binary())], names=["part", "page_id", "url", "host", "path", "digest", "body"])


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _pair(batches, contexts: dict[int, tuple], site: np.ndarray):
    """Sorted pages in; each run of equal pages is compared with the nearer of the pages before and after it on its host."""
    expand = zstandard.ZstdDecompressor().decompress
    done: list[tuple] = []

    def flush():
        ids, urls, texts = zip(*done)
        done.clear()
        return pa.RecordBatch.from_arrays([ids_column(np.array(ids, np.int64)), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=_OUT)

    def finish(before, run, after):
        """Texts of the run's pages, some at a time."""
        other = run.partner(before, after)
        at = np.minimum(np.searchsorted(site, np.array(run.keys, np.uint64)), len(site) - 1) if len(site) and run.keys else ()
        often = {k for k, a in zip(run.keys, at) if site[a] == k}
        page = text = None
        for i, url, lines in run.pages:
            if lines is not page:
                page, stay = lines, _stay(run.keys, [own for _, own in lines], other, often)
                text = "\n".join(t for (t, _), s in zip(lines, stay) if s)
            done.append((i, url, text))
            if len(done) >= 512:
                yield flush()
        run.pages = []

    before = run = at = None
    for batch in batches:
        for part, i, url, host, path, digest, body in zip(batch.column(0).to_pylist(), column_ids(batch.column(1)).tolist(), *[batch.column(k).to_pylist() for k in range(2, 7)]):
            if part != at:
                if run is not None:
                    run.last = contexts[at][2]
                    yield from finish(before, run, contexts[at][3])
                before, run, at = contexts[part][0], None, part
            page = pickle.loads(expand(body))
            if run is None or run.host != host or run.digest != digest:
                new = _Run(host, digest, [_line_key(host, t) for t, _ in page], contexts[part][1] if run is None else path, path)
                if run is not None:
                    yield from finish(before, run, new)
                    before = run
                run = new
            elif run.pages[-1][2] == page:
                page = run.pages[-1][2]  # copies are held once
            run.last = path
            run.pages.append((i, url, page))
    if run is not None:
        run.last = contexts[at][2]
        yield from finish(before, run, contexts[at][3])
    if done:
        yield flush()


#: keys drawn for a partition's bounds
SAMPLE = 100


def _bounds(keys: DataFrame, n: int) -> list[tuple]:
    """n - 1 keys or fewer that part the sorted pages into n runs of like length."""
    drawn = keys.sample(min(1.0, n * SAMPLE / max(1, keys.count())), seed=7).collect()
    drawn = sorted((r.host.encode("utf-8", "surrogatepass"), r.path.encode("utf-8", "surrogatepass"), NO_ID if r.page_id is None else r.page_id) for r in drawn)
    return [drawn[len(drawn) * k // n] for k in range(1, n)] if drawn else []


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    n = partitions(spark)
    bounds = _bounds(rows.select("host", "path", "page_id"), n)
    # equal keys are in one partition; the digest settles their order, for both passes
    place = ("part", "host", "path", F.col("page_id").asc_nulls_last(), "digest")
    outline = checkpointed(rows.mapInArrow(lambda batches: _outline(batches, bounds), _OUTLINE))
    edges = outline.select("part", "page_id", "host", "path", "digest", "keys").repartitionById(n, F.col("part")).sortWithinPartitions(*place)
    edges = edges.select("part", "host", "path", "digest", "keys").mapInArrow(_edges, "part int, runs binary").collect()
    held = spark.sparkContext.broadcast((_contexts([(r.part, pickle.loads(r.runs)) for r in edges]), site_lines(outline)))
    parsed = rows.mapInArrow(lambda batches: _parse(batches, bounds), "part int, page_id long, url string, host string, path string, digest binary, body binary")
    near = parsed.repartitionById(n, F.col("part")).sortWithinPartitions(*place)
    return near.mapInArrow(lambda batches: _pair(batches, *held.value), "page_id long, url string, text string, n_chars long")
