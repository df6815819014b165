"""SQL that states what the registered queries return, over the same tables."""
from __future__ import annotations

import re
import zlib

from .functions import tokens as T
from .sources.templates import PALETTE, RESET, parse_body

EVENT = "concat('event[', event_id, '] user=', user_id, ' type=', event_type, ' props=', props)"
ORDER = "concat('order ', o_orderkey, ' for customer ', o_custkey, ' status ', o_orderstatus, ' priority ', o_orderpriority)"
RECORD = "concat('src', l_suppkey, ' $LNIT', l_returnflag, ',', l_orderkey, ',', l_partkey, ',', l_linestatus, '*', l_linenumber)"
ORDER_RECORD = "concat('$ORDR', o_orderstatus, ',', o_orderkey, ',', o_orderpriority)"
#: uncoloured templates that the event and order lines are matched against
TEMPLATES = [
    "event[$0] user=$1 type=$2 props={\"k\": $3}",
    "event[$0] user=$1 type=click props={\"k\": $2}",
    "event[$0] user=$1 type=purchase props={\"k\": $2}",
    "event[$0] user=7 $1",
    "$0 type=view $1",
    "order $0 for customer $1 status F priority $2",
    "order $0 for customer $1 status $2 priority 1-URGENT",
    "order $0",
    "$0=$1",
    "event[0] user=$0",
]

_E = "SELECT event_id AS row_id, 'event[' || event_id || '] user=' || user_id || ' type=' || event_type || ' props=' || props AS raw FROM events"
_O = "SELECT o_orderkey AS row_id, 'order ' || o_orderkey || ' for customer ' || o_custkey || ' status ' || o_orderstatus || ' priority ' || o_orderpriority AS raw FROM orders"
_TOKEN = T.TOKEN.replace("'", "''")


def _toks(c: str) -> str:
    return f"regexp_extract_all({c}, '{_TOKEN}', 1)"


def _cat(t: str) -> str:
    return f"CASE WHEN {t}[1] = '$' THEN '$' WHEN regexp_matches({t}[1], '[A-Za-z]') THEN 'A' WHEN regexp_matches({t}[1], '[0-9]') THEN 'D' WHEN regexp_matches({t}[1], '[!-/:-@\\[-`{{-~]') THEN '@' WHEN regexp_matches({t}[1], '[ \\t\\n\\x0B\\f\\r]') THEN 'S' ELSE 'N' END"


def _sig(c: str) -> str:
    return f"list_aggregate(list_transform({_toks(c)}, lambda t: {_cat('t')} || length(t)), 'string_agg', '')"


_A = "SELECT l_linenumber::BIGINT AS label, 'src' || l_suppkey || ' $LNIT' || l_returnflag || ',' || l_orderkey || ',' || l_partkey || ',' || l_linestatus || '*' || l_linenumber AS message, 'LNIT' || l_returnflag AS identifier FROM lineitem"
_SQUARE = "SELECT a.s_suppkey::BIGINT AS i, b.s_suppkey::BIGINT AS j, levenshtein(a.s_name, b.s_name)::DOUBLE AS d FROM supplier a, supplier b"
_KNN = f"WITH s AS ({_SQUARE}), w AS (SELECT *, max(d) OVER (PARTITION BY i) - d AS w FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM w WHERE i <> j)"


def _lof(rows: str, pick: str) -> str:
    return f"""
    WITH x AS ({rows}), c AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM x),
    p AS (SELECT a.label, a.row_id AS i, b.row_id AS j, a.n, levenshtein(a.raw, b.raw)::DOUBLE AS d FROM c a JOIN c b ON a.label = b.label AND a.row_id <> b.row_id WHERE a.n > 2),
    k AS (SELECT i, d AS kdist FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM p) WHERE r = least(3, n - 1)),
    m AS (SELECT p.label, p.i, p.j, greatest(p.d, kj.kdist) AS reach FROM p JOIN k ki ON p.i = ki.i JOIN k kj ON p.j = kj.i WHERE p.d <= ki.kdist),
    l AS (SELECT i, 1 / greatest(avg(reach), 2.220446049250313e-16::DOUBLE) AS lrd FROM m GROUP BY i),
    f AS (SELECT m.i, avg(lj.lrd) / any_value(li.lrd) AS lof FROM m JOIN l li ON m.i = li.i JOIN l lj ON m.j = lj.i GROUP BY m.i),
    s AS (SELECT c.row_id, c.label, c.n, coalesce(f.lof, 0) AS lof FROM c LEFT JOIN f ON c.row_id = f.i)
    {pick}"""


def _crc(c: str, values: dict[str, int]) -> str:
    return "CASE " + c + " ".join(f" WHEN '{k}' THEN {v}" for k, v in values.items()) + " END::BIGINT"


def _crcs(c: str, names: list[str]) -> str:
    return _crc(c, {k: zlib.crc32(k.encode()) for k in names})


_STATUS = _crcs("o_orderstatus", ["F", "O", "P"])
_PRIORITY = _crcs("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
_LOG = f"SELECT row_id, raw FROM ({_E}) UNION ALL SELECT -row_id - 1, raw FROM ({_O})"
_BASES = f"WITH o AS (SELECT o_orderkey AS row_id, {_STATUS} AS label, 'order ' || o_orderkey || ' for customer ' || o_custkey || ' status ' || o_orderstatus || ' priority ' || o_orderpriority AS raw FROM orders), t AS (SELECT *, {_toks('raw')} AS toks, row_id = min(row_id) OVER (PARTITION BY label) AS base FROM o), u AS (SELECT label, row_id, base, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM t)"


def _pattern(body: str) -> str:
    """A template as a regular expression over tokens that are each closed by the unit separator."""
    out = "".join("(?:[^\\x1f]*\\x1f)*" if p else "".join(re.escape(t).replace("'", "''") + "\\x1f" for t in toks) for p, toks in parse_body(body))
    return out.replace("\\ ", " ").replace('\\"', '"')


_TEMPLATE_ROWS = ", ".join(f"({k}::BIGINT, '{_pattern(t)}')" for k, t in enumerate(TEMPLATES))
_TAGGED = "SELECT row_id, raw, list_aggregate(list_transform(" + _toks("raw") + ", lambda t: t || chr(31)), 'string_agg', '') AS s FROM "



def _signatures(rows: str) -> str:
    """CTEs s (sig, cats, lens: distinct signatures) and p (all pairs a <= b) and the distances q (sa, sb, d); rows (row_id, raw)."""
    cost = "CASE WHEN p.ca[p.i] IN ('$', 'N') OR p.cb[p.m - t + 1] IN ('$', 'N') OR p.ca[p.i] <> p.cb[p.m - t + 1] THEN 1.0::DOUBLE WHEN p.la[p.i] = p.lb[p.m - t + 1] THEN 0 ELSE 1 - 2.0::DOUBLE * least(p.la[p.i], p.lb[p.m - t + 1]) / (p.la[p.i] + p.lb[p.m - t + 1]) END"
    return f"""
    x AS ({rows}), t AS (SELECT row_id, {_toks('raw')} AS toks FROM x),
    g AS (SELECT row_id, list_transform(toks, lambda t: {_cat('t')}) AS cats, list_transform(toks, lambda t: length(t)::INT) AS lens FROM t),
    h AS (SELECT row_id, cats, lens, coalesce(array_to_string(cats, '') || array_to_string(lens, '.'), '') AS sig FROM g),
    s AS (SELECT sig, any_value(cats) AS cats, any_value(lens) AS lens, count(*) AS n, min(row_id) AS row1, (list_sort(list(row_id)))[2] AS row2 FROM h GROUP BY sig),
    a AS (SELECT l.sig AS sa, r.sig AS sb, l.cats AS ca, l.lens AS la, r.cats AS cb, r.lens AS lb, len(l.cats) AS n, len(r.cats) AS m FROM s l, s r WHERE l.sig <= r.sig),
    p AS (SELECT sa, sb, ca, la, cb, lb, n, m, n AS i, list_transform(range(0, m + 1), lambda k: k::DOUBLE) AS r FROM a
          UNION ALL SELECT sa, sb, ca, la, cb, lb, n, m, i - 1,
            list_reduce(list_transform(range(1, m + 1), lambda t: [{cost}, p.r[t], p.r[t + 1]]), lambda done, e: list_append(done, CASE WHEN e[1] = 0 THEN e[2] ELSE least(e[3] + 1, done[-1] + 1, e[1] + e[2]) END), [(n - i + 1)::DOUBLE])
          FROM p WHERE i > 0),
    q AS (SELECT sa, sb, r[-1] AS d FROM p WHERE i = 0)"""


_RUN = "STRUCT(b INT, r INT, n INT, cost DOUBLE, path INT[])"


def _paths(pairs: str) -> str:
    """CTEs pairs (pid, label, base_id, ref_id, bt, rt) and best (pid, label, base_id, ref_id, bt, path: list of runs (b, r, n)): each pair's best chain."""
    far = "1e18::DOUBLE"
    hop = "(e[1].b - (p.b + p.n - 1)) >= 2 AND (e[1].r - (p.r + p.n - 1)) >= 2"
    cand = f"list_transform(done, lambda p: CASE WHEN {hop} THEN p.cost + (e[1].b - (p.b + p.n - 1)) + (e[1].r - (p.r + p.n - 1)) - e[1].n ELSE {far} END)"
    first = f"CASE WHEN (e[1].b = 0 AND e[1].r = 0) OR (e[1].b > 0 AND e[1].r > 0) THEN (e[1].b + e[1].r - e[1].n)::DOUBLE ELSE {far} END"
    least_ = f"coalesce(list_min({cand}), {far})"
    path = f"CASE WHEN {first} <= {least_} THEN [(len(done) + 1)::INT] ELSE list_append(done[list_position({cand}, list_min({cand}))].path, (len(done) + 1)::INT) END"
    step = f"lambda done, e: list_append(done, {{'b': e[1].b, 'r': e[1].r, 'n': e[1].n, 'cost': least({first}, {least_}), 'path': {path}}})"
    ending = "CASE WHEN z.cost < 1e17 AND ((z.b + z.n - 1 = nb - 1) = (z.r + z.n - 1 = nr - 1)) THEN z.cost + (nb - (z.b + z.n - 1)) + (nr - (z.r + z.n - 1)) - 1 ELSE 1e18 END"
    return f"""
    pairs AS ({pairs}),
    cu AS (SELECT pid, unnest(bt) AS t, (generate_subscripts(bt, 1) - 1)::INT AS b FROM pairs), cv AS (SELECT pid, unnest(rt) AS t, (generate_subscripts(rt, 1) - 1)::INT AS r FROM pairs),
    cells AS (SELECT cu.pid, cu.b, cv.r, cu.b - row_number() OVER (PARTITION BY cu.pid, cu.b - cv.r ORDER BY cu.b) AS run FROM cu JOIN cv ON cu.pid = cv.pid AND cu.t = cv.t),
    segs AS (SELECT pid, min(b) AS b, min(r) AS r, count(*)::INT AS n FROM cells GROUP BY pid, b - r, run),
    lists AS (SELECT pid, list({{'b': b, 'r': r, 'n': n, 'cost': 0.0::DOUBLE, 'path': []::INT[]}} ORDER BY b, r) AS runs FROM segs GROUP BY pid),
    shapes AS (SELECT l.pid, runs, len(p.bt) AS nb, len(p.rt) AS nr, md5(runs::VARCHAR || ' ' || len(p.bt) || ' ' || len(p.rt)) AS shape FROM lists l JOIN pairs p ON l.pid = p.pid),
    chains AS (SELECT shape, any_value(nb) AS nb, any_value(nr) AS nr, list_reduce(list_transform(any_value(runs), lambda s: [s]), {step}, []::{_RUN}[]) AS runs FROM shapes GROUP BY shape),
    scored AS (SELECT shape, runs, list_transform(runs, lambda z: {ending}) AS total FROM chains),
    totals AS (SELECT pid, z.runs, total FROM shapes JOIN scored z USING (shape)),
    best AS (SELECT p.pid, p.label, p.base_id, p.ref_id, p.bt, CASE WHEN t.pid IS NULL THEN []::{_RUN}[] WHEN len(runs) = 1 THEN runs WHEN list_min(total) > 1e17 THEN []::{_RUN}[]
             ELSE list_transform(runs[list_position(total, list_min(total))].path, lambda k: runs[k]) END AS path FROM pairs p LEFT JOIN totals t ON p.pid = t.pid)"""


def _members(rows: str) -> str:
    """Pairs of each label's first row with its others; rows (label, row_id, toks)."""
    return f"WITH m AS ({rows}), f AS (SELECT label, min(row_id) AS base_id, arg_min(toks, row_id) AS bt FROM m GROUP BY label) SELECT row_number() OVER () AS pid, m.label, f.base_id, m.row_id AS ref_id, f.bt, m.toks AS rt FROM m JOIN f ON m.label = f.label AND m.row_id <> f.base_id"


_PATH_FACTS = "SELECT label, base_id, ref_id, coalesce(list_sum(list_transform(path, lambda s: s.n)), 0)::INT AS matched, len(path)::INT AS segments, list_max(list_transform(path, lambda s: s.n))::INT AS largest FROM best"
_COVERED = "SELECT label, ref_id, flatten(list_transform(path, lambda s: range(s.b, s.b + s.n))) AS places FROM best"


def _consensus(rounds: int = 3) -> str:
    """CTEs that turn best into constants (label, pos), leaving out references round by round."""
    out = [f"now0 AS ({_COVERED})"]
    for k in range(rounds + 1):
        out.append(f"refs{k} AS (SELECT label, count(*) AS refs FROM now{k} GROUP BY label)")
        out.append(f"votes{k} AS (SELECT v.label, pos, count(*) AS votes, any_value(refs) AS refs FROM (SELECT label, unnest(places) AS pos FROM now{k}) v JOIN refs{k} USING (label) GROUP BY v.label, pos)")
        out.append(f"near{k} AS (SELECT label, list(pos) AS near FROM votes{k} WHERE votes < refs AND votes > CASE WHEN refs <= 2 THEN refs WHEN refs > 10 THEN floor(refs * 0.9) ELSE refs - 2 END GROUP BY label)")
        out.append(f"now{k + 1} AS (SELECT n.* FROM now{k} n LEFT JOIN near{k} x USING (label) WHERE near IS NULL OR len(list_intersect(near, places)) = len(near))")
    out.append(f"constants AS (SELECT label, pos FROM votes{rounds} WHERE votes = refs)")
    return ", ".join(out)


_BY_STATUS = f"SELECT {_STATUS} AS label, row_id, {_toks('raw')} AS toks FROM (SELECT o_orderkey AS row_id, o_orderstatus, o_orderpriority, 'order ' || o_orderkey || ' for customer ' || o_custkey || ' status ' || o_orderstatus || ' priority ' || o_orderpriority AS raw FROM orders)"
_BOTH = [s + p for s in ("F", "O", "P") for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]
_BY_BOTH = _BY_STATUS.replace(_STATUS, _crcs("o_orderstatus || o_orderpriority", _BOTH))
_ORDER_CHAINS = f"WITH {_paths(_members(_BY_STATUS))}"
#: templates of orders by status and by both: tokens with their places, which are constant, and the number of the placeholder run they are in
_MINED = f"""WITH {_paths(_members(f'{_BY_STATUS} UNION ALL {_BY_BOTH}'))}, {_consensus()},
    base AS (SELECT DISTINCT label, base_id, bt FROM best), bu AS (SELECT label, base_id, unnest(bt) AS tok, generate_subscripts(bt, 1) - 1 AS pos FROM base),
    bf AS (SELECT bu.*, c.pos IS NOT NULL AS fixed FROM bu LEFT JOIN constants c ON bu.label = c.label AND bu.pos = c.pos),
    br AS (SELECT *, NOT fixed AND coalesce(lag(fixed) OVER (PARTITION BY label ORDER BY pos), true) AS opens FROM bf),
    bn AS (SELECT *, sum(opens::INT) OVER (PARTITION BY label ORDER BY pos) - 1 AS hole FROM br)"""


def _template_text(coloured: bool) -> str:
    hole = "'$' || hole"
    if coloured:
        codes = "[" + ", ".join(f"'{c[1:]}'" for c in PALETTE) + "]"
        hole = f"chr(27) || {codes}[(hole % {len(PALETTE)} + 1)::INT] || '$' || hole || chr(27) || '{RESET[1:]}'"
    return f"string_agg(CASE WHEN fixed THEN tok WHEN opens THEN {hole} ELSE '' END, '' ORDER BY pos)"


_AUTOMATA = """, ac AS (SELECT label, tok, pos, row_number() OVER (PARTITION BY label ORDER BY pos) - 1 AS v, coalesce(lag(pos) OVER (PARTITION BY label ORDER BY pos), -1) AS before FROM bn WHERE fixed),
    az AS (SELECT b.label, max(pos) AS last, (SELECT max(pos) FROM ac WHERE ac.label = b.label) AS fixed, (SELECT count(*) FROM ac WHERE ac.label = b.label) AS n FROM bn b GROUP BY b.label),
    ae AS (SELECT label, (v - 1)::INT AS src, v::INT AS dst, CASE WHEN pos - before > 1 THEN 'placeholder' ELSE 'constant' END AS kind FROM ac
           UNION ALL SELECT label, (n - 1)::INT, n::INT, CASE WHEN last > coalesce(fixed, -1) THEN 'placeholder' ELSE 'epsilon' END FROM az)"""
#: one template covers another if it accepts its constants, a placeholder at its end taking one token at most: what the walk comes to on these templates
_COVER = f"""{_MINED}, tt AS (SELECT label, string_agg(CASE WHEN fixed THEN tok || chr(31) ELSE '' END, '' ORDER BY pos) AS text, bool_or(NOT fixed AND pos = last) AS open_end,
        string_agg(CASE WHEN fixed THEN regexp_escape(tok) || chr(31) WHEN opens AND NOT tail THEN '(?:[^' || chr(31) || ']*' || chr(31) || ')*' ELSE '' END, '' ORDER BY pos) AS pattern
      FROM (SELECT *, max(pos) OVER (PARTITION BY label) AS last, NOT fixed AND NOT bool_or(fixed) OVER (PARTITION BY label ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM bn) GROUP BY label),
    cover AS (SELECT a.label AS i, b.label AS j, regexp_full_match(a.text, b.pattern || CASE WHEN b.open_end THEN '(?:[^' || chr(31) || ']*' || chr(31) || ')?' ELSE '' END) AS covered FROM tt a JOIN tt b ON a.label <> b.label),
    edges AS (SELECT min(j) AS src, i AS dst FROM cover WHERE covered GROUP BY i)"""
_COMPONENTS = _COVER.replace("WITH ", "WITH RECURSIVE ", 1) + """, sides AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), reach AS (SELECT label AS id, label AS other FROM tt UNION SELECT r.id, sides.b FROM reach r JOIN sides ON r.other = sides.a),
    roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id), comp AS (SELECT id AS label, dense_rank() OVER (ORDER BY root) - 1 AS component FROM roots)"""


def _matches() -> str:
    """(row_id, label, lazy, greedy): what each accepting template's placeholders take at their shortest and at their longest, tokens closed by a separator."""
    out = []
    for k, t in enumerate(TEMPLATES):
        segs = parse_body(t)
        holes = sum(p for p, _ in segs)
        pattern = lambda q, segs=segs: "^" + "".join(f"((?:[^\\x1f]*\\x1f)*{q})" if p else "".join(re.escape(x).replace("\\ ", " ").replace('\\"', '"').replace("'", "''") + "\\x1f" for x in toks) for p, toks in segs) + "$"
        names = "[" + ", ".join(f"'g{n}'" for n in range(holes)) + "]"
        group = lambda q: "[" + ", ".join(f"regexp_extract(s, '{pattern(q)}', {names})['g{n}']" for n in range(holes)) + "]"  # noqa: B023, E731
        before, n = [], 0
        for p, toks in segs:
            if p:
                before.append(n)
            n += len(toks)
        out.append(f"SELECT row_id, raw, {k}::BIGINT AS label, {group('?')} AS lazy, {group('')} AS greedy, {before} AS before FROM tagged WHERE regexp_full_match(s, '{_pattern(t)}')")
    return f"tagged AS ({_TAGGED} ({_LOG})), found AS ({' UNION ALL '.join(out)})"


_COUNT = "(length({0}) - length(replace({0}, chr(31), '')))"
_CAUGHT = f"""spans AS (SELECT row_id, label, unnest(lazy) AS g, unnest(before) AS fixed, generate_subscripts(lazy, 1) - 1 AS placeholder FROM found WHERE lazy = greedy),
    caught AS (SELECT row_id, label, placeholder::INT AS placeholder, (fixed + sum({_COUNT.format('g')}) OVER w - {_COUNT.format('g')})::INT AS token_begin, (fixed + sum({_COUNT.format('g')}) OVER w)::INT AS token_end, replace(g, chr(31), '') AS value
               FROM spans WINDOW w AS (PARTITION BY row_id, label ORDER BY placeholder))"""
_ROWS = f"SELECT o_orderkey AS row_id, {_PRIORITY} AS label, '$ORDR' || o_orderstatus || ',' || o_orderkey || ',' || o_orderpriority AS message, 'ORDR' || o_orderstatus AS identifier, o_orderstatus = 'O' AS contributor, o_orderstatus = 'F' AND o_custkey % 5 = 0 AS lost FROM orders"
_TEMPLATE_TABLE = f"""WITH a AS ({_ROWS}), n AS (SELECT label, count(*) AS members, count(*) FILTER (lost) AS lof, count(*) FILTER (contributor) AS support FROM a GROUP BY label),
    i AS (SELECT label, identifier, count(*) AS n FROM a GROUP BY ALL), j AS (SELECT label, '{{' || string_agg('"' || identifier || '":' || n, ',' ORDER BY identifier) || '}}' AS ids, count(*) AS k FROM i GROUP BY label),
    s AS (SELECT identifier FROM i GROUP BY identifier HAVING count(*) > 1), f AS (SELECT label, string_agg(identifier, ';' ORDER BY identifier) AS frag FROM i JOIN s USING (identifier) GROUP BY label),
    e AS (SELECT label, list(message ORDER BY row_id)[1:3] AS ex FROM (SELECT label, message, min(row_id) AS row_id FROM a GROUP BY ALL) GROUP BY label)
    SELECT 'R01' AS run_id, 'C' || n.label AS template_label, 'T' || n.label AS template, members AS component_membership_count, 'true' AS contributor_status_available, lof AS lof_excluded_count, members - lof - support AS accidental_excluded_count,
      members - support AS excluded_from_alignment_count, support AS alignment_support_count, ids AS identifier_counts_json, (k > 1)::VARCHAR AS mixed_identifier, coalesce(frag, '') AS fragmented_identifiers, coalesce(ex[1], '') AS example_1, coalesce(ex[2], '') AS example_2, coalesce(ex[3], '') AS example_3
    FROM n JOIN j USING (label) LEFT JOIN f USING (label) JOIN e USING (label)"""
_THREES = "SELECT s_suppkey // 3 AS label, s_suppkey AS row_id, string_split(s_name, '') AS toks FROM supplier"
_CUSTOMER_LOF = _lof("SELECT c_custkey AS row_id, c_nationkey::BIGINT AS label, c_name AS raw FROM customer", "")

SQL = {
    "tokenize_events": f"SELECT row_id, unnest({_toks('raw')}) AS token, (generate_subscripts({_toks('raw')}, 1) - 1)::INT AS pos FROM ({_E})",
    "token_intervals": f"WITH t AS (SELECT row_id, {_toks('raw')} AS k FROM ({_O})), u AS (SELECT row_id, unnest(k) AS text, (generate_subscripts(k, 1) - 1)::INT AS pos FROM t) SELECT row_id, pos, (sum(length(text)) OVER w - length(text))::INT AS lower, (sum(length(text)) OVER w)::INT AS upper, {_cat('text')} AS cat, text FROM u WINDOW w AS (PARTITION BY row_id ORDER BY pos)",
    "token_category_profile": f"SELECT {_cat('t')} AS cat, count(*) AS n, sum(length(t))::BIGINT AS chars FROM (SELECT unnest({_toks('raw')}) AS t FROM ({_E})) GROUP BY 1",
    "line_signatures": f"SELECT row_id, {_sig('raw')} AS sig FROM ({_E})",
    "signature_groups": f"WITH s AS (SELECT row_id, {_sig('raw')} AS sig FROM ({_E})) SELECT sig, count(*) AS n, min(row_id) AS row1, (list_sort(list(row_id)))[2] AS row2 FROM s GROUP BY sig",
    "signature_topk": f"SELECT {_sig('raw')} AS sig, count(*) AS n FROM ({_E}) GROUP BY 1 ORDER BY n DESC, sig LIMIT 10",
    "ansi_strip": "SELECT event_id, event_type || ' ' || props AS text FROM events",
    "nmea_prepare": "SELECT id, record, count(*) AS copies FROM (SELECT l_orderkey * 10 + l_linenumber AS id, '$LNIT' || l_returnflag || ',' || l_orderkey || ',' || l_partkey || ',' || l_linestatus || '*' || l_linenumber AS record FROM lineitem) GROUP BY ALL",
    "split_documents": r"WITH r AS (SELECT doc_id AS id, unnest(string_split(regexp_replace(replace(text, '\r\n', chr(10)), '\r\n?', chr(10), 'g'), chr(10))) AS record FROM documents) SELECT id, count(*) AS n, sum(length(record))::BIGINT AS chars FROM r WHERE record <> '' GROUP BY id",
    "nmea_identifier_counts": f"SELECT identifier, count(*) AS messages FROM ({_A}) GROUP BY identifier",
    "identifier_fragmentation": f"SELECT identifier, count(DISTINCT label) AS labels, string_agg(DISTINCT label::VARCHAR, ';' ORDER BY label::VARCHAR) AS templates, count(DISTINCT label) > 1 AS fragmented FROM ({_A}) GROUP BY identifier",
    "mixed_templates": f"SELECT label, count(DISTINCT identifier) AS identifiers FROM ({_A}) GROUP BY label HAVING count(DISTINCT identifier) > 1",
    "distinct_examples": f"WITH f AS (SELECT {_STATUS} AS label, o_orderpriority AS message, min(o_orderkey) AS k FROM orders GROUP BY ALL), r AS (SELECT label, message, (row_number() OVER (PARTITION BY label ORDER BY k))::INT AS rank FROM f) SELECT * FROM r WHERE rank <= 3",
    "char_levenshtein_pairs": "SELECT a.s_suppkey AS i, b.s_suppkey AS j, levenshtein(a.s_name, b.s_name)::BIGINT AS d FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey",
    "row_similarity": f"WITH s AS ({_SQUARE}) SELECT i, j, d, max(d) OVER (PARTITION BY i) - d AS w FROM s",
    "knn_graph": f"{_KNN} SELECT least(i, j) AS src, greatest(i, j) AS dst, min(w) AS weight FROM r WHERE r = 1 GROUP BY 1, 2",
    "directed_knn_graph": f"{_KNN} SELECT i AS src, j AS dst, w AS weight FROM r WHERE r <= 3",
    "connected_components": f"WITH RECURSIVE e AS ({_KNN} SELECT i, j FROM r WHERE r = 1), b AS (SELECT i, j FROM e UNION SELECT j, i FROM e), c AS (SELECT s_suppkey::BIGINT AS id, s_suppkey::BIGINT AS other FROM supplier UNION SELECT c.id, b.j FROM c JOIN b ON c.other = b.i), m AS (SELECT id, min(other) AS root FROM c GROUP BY id) SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM m",
    "label_groups": "SELECT c_nationkey::BIGINT AS label, c_custkey AS row_id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS local FROM customer",
    "lof_scores": _lof("SELECT c_custkey AS row_id, c_nationkey::BIGINT AS label, c_name AS raw FROM customer", "SELECT row_id, label, n, round(lof, 6) AS lof FROM s"),
    "lof_excluded": _lof("SELECT p_partkey AS row_id, p_size::BIGINT AS label, p_name AS raw FROM part", "SELECT row_id, label, (n > 2 AND lof >= 1.5) AS excluded, CASE WHEN NOT (n > 2 AND lof >= 1.5) THEN row_number() OVER (PARTITION BY label, n > 2 AND lof >= 1.5 ORDER BY row_id) - 1 END AS local FROM s"),
    "diagonal_segments": f"""{_BASES},
        c AS (SELECT r.label, r.row_id AS ref_id, b.pos AS b, r.pos AS r, b.pos - r.pos AS diag FROM u r JOIN u b ON r.label = b.label AND r.tok = b.tok AND b.base WHERE NOT r.base),
        g AS (SELECT *, b - row_number() OVER (PARTITION BY label, ref_id, diag ORDER BY b) AS run FROM c)
        SELECT label, ref_id, min(b)::INT AS b_start, min(r)::INT AS r_start, count(*)::INT AS len FROM g GROUP BY label, ref_id, diag, run""",
    "unanimous_tokens": f"{_BASES}, n AS (SELECT label, count(*) AS members FROM o GROUP BY label), a AS (SELECT label, pos, count(DISTINCT tok) AS n_distinct, min(tok) AS t, count(*) AS k FROM u GROUP BY label, pos) SELECT a.label, pos::INT AS pos, n_distinct, CASE WHEN n_distinct = 1 AND k = members THEN t END AS token FROM a JOIN n ON a.label = n.label",
    "template_match": f"WITH t(label, pattern) AS (VALUES {_TEMPLATE_ROWS}), l AS ({_TAGGED} ({_LOG})) SELECT row_id, label FROM l, t WHERE regexp_full_match(s, pattern)",
    "unmatched_lines": "SELECT c_custkey + 1 AS line, c_name AS message FROM customer WHERE c_nationkey % 2 <> 0",
    "partition_equivalence": """WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), p AS (SELECT sum(n * (n - 1) / 2) AS v, count(*) AS k, sum(n) AS m FROM c),
        q AS (SELECT sum(n * (n - 1) / 2) AS v, count(*) AS k FROM (SELECT sum(n) AS n FROM c GROUP BY a)), r AS (SELECT sum(n * (n - 1) / 2) AS v, count(*) AS k FROM (SELECT sum(n) AS n FROM c GROUP BY b))
        SELECT p.m::BIGINT AS messages, q.k = r.k AND r.k = p.k AS equivalent, round((p.v - q.v * r.v / (p.m * (p.m - 1) / 2)) / ((q.v + r.v) / 2 - q.v * r.v / (p.m * (p.m - 1) / 2)), 9) AS adjusted_rand_index FROM p, q, r""",
    "component_counts": f"SELECT {_PRIORITY} AS label, count(*) AS members, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 5 = 0) AS lof_excluded, count(*) - count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 5 = 0) - count(*) FILTER (o_orderstatus = 'O') AS accidental, count(*) - count(*) FILTER (o_orderstatus = 'O') AS excluded, count(*) FILTER (o_orderstatus = 'O') AS support FROM orders GROUP BY 1",
    "evaluation_totals": "WITH c AS (SELECT o_orderpriority, count(*) AS members, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 5 = 0) AS lof, count(*) FILTER (o_orderstatus = 'O') AS support FROM orders GROUP BY 1) SELECT sum(lof)::BIGINT AS lof_excluded, sum(members - lof - support)::BIGINT AS accidental, sum(members - support)::BIGINT AS excluded, sum(support)::BIGINT AS support, count(*) FILTER (lof > 0) AS components_with_lof, count(*) FILTER (members > support) AS components_with_exclusions FROM c",
    "sha_shuffle": f"WITH k AS (SELECT row_id, raw, sha256('sha256-sort-v1' || chr(0) || '20260710' || chr(0) || (row_id + 1)) AS h FROM ({_O})) SELECT row_number() OVER (ORDER BY h, row_id) - 1 AS new_id, row_id, sha256(raw) AS record_sha256 FROM k",
    "dense_numbers": "SELECT c_custkey, row_number() OVER (ORDER BY c_name DESC) - 1 AS place FROM customer",
    "soft_knn_graph": f"""WITH RECURSIVE s AS ({_SQUARE}), w AS (SELECT *, max(d) OVER (PARTITION BY i) - d AS w FROM s), o AS (SELECT i, row_number() OVER (ORDER BY i) AS at, list(least(i, j) * 1000000 + greatest(i, j) ORDER BY d, j) AS keys FROM w WHERE i <> j GROUP BY i),
        t AS (SELECT 0::BIGINT AS at, []::BIGINT[] AS edges, []::BIGINT[] AS own UNION ALL SELECT o.at, list_concat(t.edges, list_filter(o.keys, lambda k: NOT list_contains(t.edges, k))[1:2]), list_filter(o.keys, lambda k: NOT list_contains(t.edges, k))[1:2] FROM t JOIN o ON o.at = t.at + 1),
        v AS (SELECT o.i, unnest(CASE WHEN len(t.own) < 2 THEN o.keys ELSE o.keys[1:list_position(o.keys, t.own[2])] END) AS k FROM t JOIN o ON o.at = t.at)
        SELECT k // 1000000 AS src, k % 1000000 AS dst, min(w.w) AS weight FROM v JOIN w ON w.i = v.i AND least(w.i, w.j) * 1000000 + greatest(w.i, w.j) = k GROUP BY k""",
    "dbscan_clusters": f"""WITH RECURSIVE s AS ({_SQUARE}), near AS (SELECT * FROM s WHERE d <= 1), core AS (SELECT i AS id FROM near GROUP BY i HAVING count(*) >= 4),
        b AS (SELECT i, j FROM near WHERE i IN (FROM core) AND j IN (FROM core)), c AS (SELECT id, id AS other FROM core UNION SELECT c.id, b.j FROM c JOIN b ON c.other = b.i),
        l AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM (SELECT id, min(other) AS root FROM c GROUP BY id)),
        e AS (SELECT i AS id, arg_min(label, d * 1000000 + j) AS label FROM near JOIN l ON near.j = l.id WHERE i <> j AND i NOT IN (FROM core) GROUP BY i)
        SELECT s_suppkey::BIGINT AS id, coalesce(l.label, e.label) AS label FROM supplier LEFT JOIN l ON l.id = s_suppkey LEFT JOIN e ON e.id = s_suppkey""",
    "structural_distances": f"""WITH RECURSIVE {_signatures("SELECT n_nationkey::BIGINT AS row_id, n_name AS raw FROM nation UNION ALL SELECT -s_suppkey - 1, s_name FROM supplier")}
        SELECT a.row_id AS i, b.row_id AS j, round(q.d, 9) AS d FROM h a JOIN h b ON a.row_id < b.row_id JOIN q ON q.sa = least(a.sig, b.sig) AND q.sb = greatest(a.sig, b.sig)""",
    "nearest_lines": f"""WITH RECURSIVE {_signatures(_E)}, z AS (SELECT sa, sb, d FROM q UNION ALL SELECT sb, sa, d FROM q WHERE sa <> sb), y AS (SELECT z.*, s.row1, s.row2 FROM z JOIN s ON z.sb = s.sig WHERE sa <> sb OR s.n > 1)
        SELECT h.row_id AS i, arg_min(CASE WHEN y.row1 <> h.row_id THEN y.row1 ELSE y.row2 END, (y.d, CASE WHEN y.row1 <> h.row_id THEN y.row1 ELSE y.row2 END)) AS j, round(min(y.d), 9) AS d, round(max(y.d) - min(y.d), 9) AS weight FROM h JOIN y ON h.sig = y.sa GROUP BY h.row_id""",
    "token_common_lengths": """WITH RECURSIVE p AS (SELECT a.n_nationkey::BIGINT AS i, b.n_nationkey::BIGINT AS j, string_split(a.n_name, '') AS a, string_split(b.n_name, '') AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey),
        r AS (SELECT i, j, a, b, 0 AS k, list_transform(range(0, len(b) + 1), lambda x: 0::BIGINT) AS r FROM p
          UNION ALL SELECT i, j, a, b, k + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda t: [CASE WHEN r.a[r.k + 1] = r.b[t] THEN r.r[t] + 1 ELSE r.r[t + 1] END]), lambda done, e: list_append(done, greatest(e[1], done[-1])), [0::BIGINT]) FROM r WHERE k < len(a))
        SELECT i, j, r[-1]::INT AS n FROM r WHERE k = len(a)""",
    "subset_texts": f"SELECT row_id, array_to_string({_toks('raw')}[3:5], '') AS text FROM ({_O})",
    "grid_places": """WITH p AS (SELECT l_linenumber::INT AS a, (l_partkey % 7)::INT AS b, 3 AS c FROM lineitem) SELECT (a + 1) || ',' || (b + 1) || ',' || (c + 1) AS below, (a - 1) || ',' || (b - 1) || ',' || (c - 1) AS above, (a - 1) || ',' || b || ',' || (c - 2) AS apart, (a + 1) || ',' || b || ',' || (c + 2) AS both, a = 0 OR b = 0 AS top, a + b + c AS l1, count(*) AS n FROM p GROUP BY ALL""",
    "grid_faces": """WITH g AS (SELECT n_nationkey::BIGINT AS label, length(r_name)::INT AS a, length(n_name)::INT AS b FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT label, 0 AS face, unnest(range(0, a))::INT AS x, b - 1 AS y FROM g UNION ALL SELECT label, 1, a - 1, unnest(range(0, b))::INT FROM g""",
    "common_runs": f"""WITH m AS ({_THREES}), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_id) AS k FROM m), u AS (SELECT label, k, unnest(toks) AS t, (generate_subscripts(toks, 1) - 1)::INT AS p FROM n),
        c AS (SELECT a.label, a.p AS p0, b.p AS p1, c.p AS p2 FROM u a JOIN u b ON a.label = b.label AND a.t = b.t JOIN u c ON a.label = c.label AND a.t = c.t WHERE a.k = 1 AND b.k = 2 AND c.k = 3),
        g AS (SELECT *, p0 - row_number() OVER (PARTITION BY label, p1 - p0, p2 - p0 ORDER BY p0) AS run FROM c)
        SELECT label, min(p0) AS p0, min(p1) AS p1, min(p2) AS p2, count(*)::INT AS len FROM g GROUP BY label, p1 - p0, p2 - p0, run""",
    "chain_graph": f"""WITH {_paths(_members(_THREES))}, x AS (SELECT s.*, p.label, p.ref_id, s.b + s.n - 1 AS be, s.r + s.n - 1 AS re, len(p.bt) AS nb, len(p.rt) AS nr, s.b || ',' || s.r AS name FROM segs s JOIN pairs p ON s.pid = p.pid)
        SELECT label, ref_id, 'S' AS src, name AS dst, (b + r - n)::INT AS weight FROM x WHERE (b = 0 AND r = 0) OR (b > 0 AND r > 0)
        UNION ALL SELECT p.label, p.ref_id, p.name, q.name, (q.b - p.be + q.r - p.re - q.n)::INT FROM x p JOIN x q ON p.pid = q.pid AND q.b - p.be >= 2 AND q.r - p.re >= 2
        UNION ALL SELECT label, ref_id, name, 'T', (nb - be + nr - re - 1)::INT FROM x WHERE (be = nb - 1) = (re = nr - 1)""",
    "best_chains": f"{_ORDER_CHAINS} {_PATH_FACTS}",
    "known_paths": f"{_ORDER_CHAINS} {_PATH_FACTS}",
    "target_paths": f"WITH {_paths("SELECT row_number() OVER () AS pid, 0::BIGINT AS label, a.n_nationkey::BIGINT AS base_id, b.n_nationkey::BIGINT AS ref_id, string_split(a.n_name, '') AS bt, string_split(b.n_name, '') AS rt FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey WHERE b.n_nationkey = 7")} {_PATH_FACTS}",
    "character_alignment": f"""WITH {_paths("SELECT row_number() OVER () AS pid, a.n_regionkey::BIGINT AS label, a.n_nationkey::BIGINT AS base_id, b.n_nationkey::BIGINT AS ref_id, string_split(a.n_name, '') AS bt, string_split(b.n_name, '') AS rt FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")},
        d AS (SELECT base_id AS i, ref_id AS j, len(bt) - sqrt(coalesce(list_sum(list_transform(path, lambda s: (s.n * s.n)::DOUBLE)), 0)) AS d FROM best)
        SELECT i, j, round(greatest(d - coalesce(min(CASE WHEN d > 0 THEN d END) OVER (PARTITION BY i), 0), 0), 9) AS d FROM d""",
    "segment_cooccurrence": f"""{_ORDER_CHAINS}, w AS (SELECT list_concat(['S'], list_transform(path, lambda s: array_to_string(bt[s.b + 1 : s.b + s.n], '')), ['T']) AS w FROM best WHERE len(path) > 1), y AS (SELECT w, unnest(range(1, len(w))) AS k FROM w) SELECT w[k] AS text, w[k + 1] AS next_text, count(*) AS n FROM y GROUP BY 1, 2""",
    "consensus_votes": f"{_ORDER_CHAINS}, r AS (SELECT label, count(*) AS refs FROM best GROUP BY label), v AS (SELECT label, unnest(places) AS pos FROM ({_COVERED})) SELECT v.label, pos::INT AS pos, count(*) AS votes, any_value(refs) AS refs FROM v JOIN r USING (label) GROUP BY v.label, pos",
    "half_consensus": f"{_ORDER_CHAINS}, r AS (SELECT label, count(*) AS refs FROM best GROUP BY label), v AS (SELECT label, unnest(places) AS pos FROM ({_COVERED})) SELECT v.label, pos::INT AS pos FROM v JOIN r USING (label) GROUP BY v.label, pos HAVING count(*) >= greatest(1, floor(any_value(refs) * 0.5))",
    "cluster_templates": f"{_MINED.replace(_BY_BOTH, _BY_STATUS + ' WHERE false')} SELECT label, base_id, {_template_text(False)} AS text FROM bn GROUP BY label, base_id",
    "line_regions": f"""{_ORDER_CHAINS}, {_consensus()}, cl AS (SELECT label, list(pos) AS places FROM constants GROUP BY label),
        own AS (SELECT b.label, b.ref_id AS row_id, p.rt AS toks, CASE WHEN n.ref_id IS NULL THEN [] ELSE flatten(list_transform(b.path, lambda s: list_transform(list_filter(cl.places, lambda x: x >= s.b AND x < s.b + s.n), lambda x: x - s.b + s.r))) END AS places
                FROM best b JOIN pairs p ON b.pid = p.pid LEFT JOIN now4 n ON b.label = n.label AND b.ref_id = n.ref_id LEFT JOIN cl ON b.label = cl.label UNION ALL SELECT DISTINCT b.label, base_id, bt, coalesce(cl.places, []) FROM best b LEFT JOIN cl ON b.label = cl.label),
        ou AS (SELECT label, row_id, places, unnest(toks) AS tok, (generate_subscripts(toks, 1) - 1) AS pos FROM own), of AS (SELECT *, NOT list_contains(places, pos) AS is_ph FROM ou), oc AS (SELECT *, coalesce(is_ph <> lag(is_ph) OVER (PARTITION BY label, row_id ORDER BY pos), true) AS opens FROM of),
        org AS (SELECT *, sum(opens::INT) OVER (PARTITION BY label, row_id ORDER BY pos) AS g FROM oc) SELECT label, row_id, min(pos)::INT AS lower, (max(pos) + 1)::INT AS upper, any_value(is_ph) AS is_ph FROM org GROUP BY label, row_id, g""",
    "template_texts": f"{_MINED} SELECT label, {_template_text(False)} AS text, {_template_text(True)} AS coloured FROM bn GROUP BY label",
    "parsed_templates": f"{_MINED} SELECT label, {_template_text(False)} AS text FROM bn GROUP BY label",
    "template_automata": f"{_MINED}{_AUTOMATA} SELECT * FROM ae",
    "template_coverage": f"{_COVER} SELECT * FROM cover",
    "template_graph": f"{_COVER} SELECT src, dst, 1.0::DOUBLE AS weight FROM edges",
    "template_components": f"{_COMPONENTS} SELECT label, component FROM comp",
    "component_bases": f"{_COMPONENTS}, ind AS (SELECT c.label, c.component, count(e.src) AS n FROM comp c LEFT JOIN edges e ON e.dst = c.label GROUP BY ALL) SELECT component, arg_min(label, -n * 10000000000 + label) AS base, count(*) AS size FROM ind GROUP BY component",
    "row_components": f"{_COMPONENTS} SELECT o_orderkey AS row_id, comp.label, component FROM orders JOIN comp ON comp.label = {_crcs('o_orderstatus || o_orderpriority', _BOTH)}",
    "match_ambiguous": f"WITH {_matches()} SELECT row_id, label, lazy <> greedy AS ambiguous FROM found",
    "match_captures": f"WITH {_matches()}, {_CAUGHT} SELECT * FROM caught",
    "match_json": f"""WITH {_matches()}, {_CAUGHT}, parts AS (SELECT row_id, label, string_agg('{{"placeholder":' || placeholder || ',"token_begin":' || token_begin || ',"token_end":' || token_end || ',"value":' || to_json(value)::VARCHAR || '}}', ',' ORDER BY placeholder) AS c FROM caught GROUP BY ALL),
        each AS (SELECT f.row_id, string_agg('{{"template":"C' || f.label || '","capture_ambiguous":' || (lazy <> greedy)::VARCHAR || ',"captures":' || CASE WHEN lazy <> greedy THEN 'null' ELSE '[' || coalesce(c, '') || ']' END || '}}', ',' ORDER BY f.label) AS m FROM found f LEFT JOIN parts p ON f.row_id = p.row_id AND f.label = p.label GROUP BY f.row_id)
        SELECT '{{"line":' || CASE WHEN l.row_id < 0 THEN -l.row_id ELSE l.row_id + 1 END || ',"message":' || to_json(l.raw)::VARCHAR || ',"matches":[' || coalesce(m, '') || ']}}' AS value FROM ({_LOG}) l LEFT JOIN each ON l.row_id = each.row_id""",
    "template_jaccard": "WITH l AS (SELECT n_name AS t FROM nation UNION SELECT r_name FROM region), r AS (SELECT c_mktsegment AS t FROM customer UNION SELECT r_name FROM region) SELECT (SELECT count(*) FROM (FROM l INTERSECT FROM r)) AS shared, (SELECT count(*) FROM (FROM l UNION FROM r)) AS \"all\", round((SELECT count(*) FROM (FROM l INTERSECT FROM r))::DOUBLE / (SELECT count(*) FROM (FROM l UNION FROM r)), 9) AS jaccard",
    "assignments": f"SELECT row_id, label, 'T' || label AS template, contributor, identifier, message FROM ({_ROWS})",
    "template_rows": _TEMPLATE_TABLE,
    "template_rows_csv": f"SELECT template_label, component_membership_count::VARCHAR AS component_membership_count, alignment_support_count::VARCHAR AS alignment_support_count, example_1 FROM ({_TEMPLATE_TABLE})",
    "restored_labels": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, (row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS label FROM orders",
    "read_text_lines": f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, 2 * row_number() OVER (ORDER BY row_id) - 1 AS source_line, raw FROM ({_O})",
    "graphml_edges": f"{_KNN} SELECT least(i, j) AS src, greatest(i, j) AS dst, CASE WHEN min(w) = 0 THEN 2.220446049250313e-16::DOUBLE ELSE min(w) END AS weight FROM r WHERE r = 1 GROUP BY 1, 2",
    "label_totals": "SELECT count(DISTINCT nullif(c_nationkey, 0)) AS labels, count(*) FILTER (c_nationkey = 0) AS unclustered FROM customer",
    "contributors": f"{_CUSTOMER_LOF} SELECT row_id, label FROM s WHERE NOT (n > 2 AND lof >= 1.5)",
    "exclusions": f"{_CUSTOMER_LOF} SELECT row_id, label, 'lof' AS reason FROM s WHERE n > 2 AND lof >= 1.5",
    "report_counts": f"{_CUSTOMER_LOF}, kk AS (SELECT label, count(*) AS members, count(*) FILTER (n > 2 AND lof >= 1.5) AS lost FROM s GROUP BY label) SELECT label, members, lost AS lof_excluded, 0::BIGINT AS accidental, members - lost AS support FROM kk",
}

SQL["cached_signatures"] = SQL["signature_groups"]
