"""DuckDB SQL for the catalog's queries, on the same Parquet tables."""

from __future__ import annotations

from packspark.functions import signals
from packspark.functions import text as T
from packspark.operators.budget import BUCKETS
from packspark.plans import demo
from packspark.settings import INTENT_BUDGETS


def _quoted(words) -> str:  # noqa: ANN001
    return ", ".join(f"'{w}'" for w in words)


_BATCH = demo.batch_sql()
_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _lines(text: str) -> str:
    parts = f"regexp_split_to_array({text}, '{_BREAK}')"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def _tokens(text: str) -> str:
    return f"CASE WHEN length({text}) = 0 THEN 0 ELSE greatest(1, length({text}) // 4) END"


def _ordered(words: str) -> str:
    """A list without repeats, in order."""
    return f"list_transform(list_filter(list_zip({words}, range(1, len({words}) + 1)), lambda z: list_position({words}, z[1]) = z[2]), lambda z: z[1])"


def _intent(source: str) -> str:
    """CTEs that give query_id, intent, confidence for rows (query_id, query)."""
    score = lambda k: " + ".join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in signals.INTENT_WORDS[k])
    sums = ", ".join(f"{score(k)} AS {k}" for k in signals.TIE_ORDER if k != "debug")
    trace = signals.STACK_TRACE.replace("'", "''")
    case = " ".join(f"WHEN {k} = best THEN '{k}'" for k in signals.TIE_ORDER)
    return f"""
q AS ({source}), l AS (SELECT query_id, query, lower(query) AS low, regexp_matches(lower(query), '(?i){trace}') AS trace FROM q),
s AS (SELECT *, {score("debug")} + CASE WHEN trace THEN 2 ELSE 0 END AS debug, {sums} FROM l),
b AS (SELECT *, greatest({", ".join(signals.TIE_ORDER)}) AS best, {" + ".join(signals.TIE_ORDER)} AS total FROM s),
i AS (SELECT *, CASE WHEN best = 0 THEN 'implement' {case} END AS intent,
  CASE WHEN best = 0 THEN CAST(0.3 AS DOUBLE) ELSE round(greatest(CAST(0.4 AS DOUBLE), least(CAST(0.99 AS DOUBLE), CAST(best AS DOUBLE) / total)), 2) END AS confidence FROM b)"""


def _budget(i: int) -> str:
    return "CASE intent " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in INTENT_BUDGETS.items()) + " END"


def _keywords(source: str) -> str:
    """CTEs that give query_id, ord, kw for rows (query_id, query)."""
    return rf"""
kq AS ({source}),
kw0 AS (SELECT query_id, unnest(regexp_extract_all(query, '{T.KEYWORD}')) AS w, generate_subscripts(regexp_extract_all(query, '{T.KEYWORD}'), 1) AS i FROM kq),
kw1 AS (SELECT query_id, i, w, string_split(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' ') AS parts FROM kw0 WHERE lower(w) NOT IN ({_quoted(T.STOPWORDS)})),
kw2 AS (
  SELECT query_id, i, 0 AS j, w AS kw FROM kw1
  UNION ALL SELECT query_id, i, generate_subscripts(parts, 1) AS j, unnest(parts) AS kw FROM kw1 WHERE len(parts) > 1
),
kw3 AS (SELECT query_id, kw, row_number() OVER (PARTITION BY query_id, lower(kw) ORDER BY i, j) AS nth, i, j FROM kw2 WHERE j = 0 OR length(kw) >= 3),
kws AS (SELECT query_id, kw, row_number() OVER (PARTITION BY query_id ORDER BY i, j) AS ord FROM kw3 WHERE nth = 1)"""


_TURNS = "SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations"
_FILES = "files AS (SELECT coalesce(source, 'none') || '/doc' || doc_id || '.md' AS path, doc_id, text AS content FROM documents WHERE length(text) > 0)"
_HITS = f"""{_keywords(f"SELECT * FROM {_BATCH}")},
{_FILES},
fl AS (SELECT path, {_lines("content")} AS lines FROM files),
ln AS (SELECT path, len(lines) AS total, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM fl),
hits AS (SELECT DISTINCT query_id, path, line_no, total FROM ln JOIN (SELECT DISTINCT query_id, lower(kw) AS k FROM kws) x ON contains(lower(line), k))"""
_ISLANDS = f"""{_HITS},
brk AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER w > 17 THEN 1 ELSE 0 END AS brk FROM hits WINDOW w AS (PARTITION BY query_id, path ORDER BY line_no)),
isl AS (SELECT *, sum(brk) OVER (PARTITION BY query_id, path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS n FROM brk),
rng AS (SELECT query_id, path, greatest(1, min(line_no) - 8) AS start_line, least(max(total), max(line_no) + 8) AS end_line FROM isl GROUP BY query_id, path, n)"""
_CHUNKS = f"""{_ISLANDS},
snip AS (SELECT r.*, array_to_string(f.lines[start_line:end_line], chr(10)) AS content FROM rng r JOIN fl f USING (path)),
chk AS (SELECT s.*, CAST((SELECT count(DISTINCT lower(kw)) FROM kws k WHERE k.query_id = s.query_id AND contains(lower(s.content), lower(k.kw))) AS DOUBLE) AS keyword_match FROM snip s)"""
_TOPK = f"""{_CHUNKS},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_match DESC, path, start_line) AS n FROM chk) WHERE n <= 50)"""
_GENERATED = """
spans AS (
  SELECT 'geo/n' || n_nationkey || '.py' AS path, unnest([0, 1, 2]) AS ord, unnest(['load_n' || n_nationkey, 'Nation' || n_nationkey, 'total']) AS name, unnest([4, 8, 9]) AS start_line, unnest([6, 10, 10]) AS end_line FROM nation
  UNION ALL SELECT 'web/s' || s_suppkey || '.ts', unnest([0, 1]), unnest(['Supplier' || s_suppkey, 'pay']), unnest([1, 2]), unnest([5, 4]) FROM supplier
  UNION ALL SELECT 'web/p' || p_partkey || '.ts', unnest([0, 1]), unnest(['loadPart' || p_partkey, 'if']), unnest([2, 3]), unnest([6, 5]) FROM part
)"""
_SIZES = """
sizes AS (
  SELECT 'geo/n' || n_nationkey || '.py' AS path, 16 AS slice, length('import geo.r' || n_regionkey || chr(10) || 'from . import shared' || chr(10) || chr(10) || '@tag' || chr(10) || 'def load_n' || n_nationkey || '(x):' || chr(10) || '    return x' || chr(10) || chr(10) || 'class Nation' || n_nationkey || ':' || chr(10) || '    def total(self):' || chr(10) || '        return 1') AS head FROM nation
  UNION ALL SELECT 'web/s' || s_suppkey || '.ts', NULL, length('export class Supplier' || s_suppkey || ' {' || chr(10) || '  pay(amount) {' || chr(10) || '    return amount;' || chr(10) || '  }' || chr(10) || '}') FROM supplier
  UNION ALL SELECT 'web/p' || p_partkey || '.ts', NULL, length('import { Supplier } from ''./s' || (p_partkey % 10) || ''';' || chr(10) || 'export function loadPart' || p_partkey || '(a) {' || chr(10) || '  if (a) {' || chr(10) || '    return 1;' || chr(10) || '  }' || chr(10) || '}') FROM part
)"""
_EDGES = """
edges AS (
  SELECT 'geo/n' || n_nationkey || '.py' AS src, 0 AS ord, 'geo/r' || r_regionkey || '.py' AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'geo/n' || n_nationkey || '.py', 1, 'geo/__init__.py' FROM nation
  UNION ALL SELECT 'web/p' || p_partkey || '.ts', 0, 'web/s' || s_suppkey || '.ts' FROM part JOIN supplier ON s_suppkey = p_partkey % 10
)"""
_MENTIONS = "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in demo.SYMBOL_MENTIONS) + ") AS m(query_id, symbol)"
#: Which files the batch mentions, as (query_id, mention): found by eye, so that SQL needs no word boundaries.
_MENTIONED = "(VALUES (1, 'src3/doc12.md'), (1, 'doc7.md'), (4, 'src1/doc40.md'), (8, 'geo/n3.py'), (8, 'web/p5.ts'), (8, 'web/s2.ts')) AS m(query_id, mention)"
_SNAP = "coalesce(list_filter([{0}], lambda b: b >= {1})[1], 15000)"
_SCORED = """
c0 AS (
  SELECT n_chars % 7 AS query_id, 'd' || doc_id AS path, doc_id, ['grep', 'symbol', 'import', 'inferred_anchor'][doc_id % 4 + 1] AS tier, CAST(doc_id % 11 AS DOUBLE) AS kw,
    [CAST(0 AS DOUBLE), 0, 0.75, 1][doc_id % 4 + 1] AS pm0, (doc_id % 2) * CAST(0.7 AS DOUBLE) AS ip, doc_id % 3 = 0 AS anchor, doc_id % 5 AS tier_rank FROM documents
),
c1 AS (
  SELECT *, CASE WHEN anchor AND pm0 = 0 THEN CAST(0.5 AS DOUBLE) ELSE pm0 END AS path_mention,
    (doc_id - min(doc_id) OVER w) / CAST(CASE WHEN max(doc_id) OVER w > min(doc_id) OVER w THEN max(doc_id) OVER w - min(doc_id) OVER w ELSE 1 END AS DOUBLE) AS recency,
    CASE WHEN max(kw) OVER w > 0 THEN kw / max(kw) OVER w ELSE CAST(0 AS DOUBLE) END AS nkw
  FROM c0 WINDOW w AS (PARTITION BY query_id)
),
c2 AS (
  SELECT *, round(CAST(0.4 AS DOUBLE) * nkw + CAST(0.3 AS DOUBLE) * least(CAST(1 AS DOUBLE), path_mention) + CAST(0.2 AS DOUBLE) * least(CAST(1 AS DOUBLE), ip) + CAST(0.1 AS DOUBLE) * least(CAST(1 AS DOUBLE), recency), 4) AS score,
    coalesce(nullif(concat_ws(', ', CASE WHEN path_mention > 0 THEN 'explicitly mentioned path' END, CASE tier WHEN 'symbol' THEN 'symbol slice' WHEN 'import' THEN 'import neighbor' WHEN 'inferred_anchor' THEN 'inferred anchor' END,
      CASE WHEN kw > 0 AND tier = 'grep' THEN 'keyword match' END, CASE WHEN ip > 0 AND tier <> 'import' THEN 'near anchor in import graph' END), ''), 'candidate') AS reason
  FROM c1
)"""

_LETTERS = "[" + ", ".join(f"CAST(length({{0}}) - length(replace({{0}}, '{c}', '')) AS DOUBLE)" for c in "aeinot") + "]"

SQL: dict[str, str] = {
    "token_estimate": f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents",
    "line_counts": f"SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS newline_count, len({_lines('text')}) AS n_lines FROM documents",
    "evidence_lines": rf"""
WITH j AS (SELECT doc_id, array_to_string(list_filter(list_transform({_lines("text")}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ') AS e FROM documents)
SELECT doc_id, CASE WHEN length(e) <= 220 THEN e ELSE regexp_replace(substr(e, 1, 217), '\s+$', '') || '...' END AS evidence FROM j""",
    "keyword_extract": f"WITH {_keywords(_TURNS)} SELECT query_id // 1000 AS conv_id, query_id % 1000 AS turn, ord, kw FROM kws",
    "path_word_lists": rf"SELECT page_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(ws), lambda x: lpad(CAST(list_position(ws, x) AS VARCHAR), 6, '0') || x)), lambda x: substr(x, 7)), ' ') AS words FROM (SELECT page_id, regexp_extract_all(lower(regexp_replace(url, '([^/])\.[^./]+$', '\1')), '{T.PATH_WORD}') AS ws FROM pages)",
    "intent_classify": f"WITH {_intent(f'{_TURNS} UNION ALL SELECT -query_id, query FROM {_BATCH}')} SELECT query_id, intent, confidence, {_budget(0)} AS recommended, {_budget(1)} AS least, {_budget(2)} AS most FROM i",
    "query_signals": rf"""
WITH {_intent(f'{_TURNS} UNION ALL SELECT -query_id, query FROM {_BATCH}')},
m AS (SELECT *, {_ordered("list_transform(regexp_extract_all(query, '(?i)" + signals.FILE + "'), lambda x: replace(x, chr(92), '/'))")} AS files,
  list_concat(list_filter(list_transform(regexp_extract_all(query, '{signals.BACKTICK}', 1), lambda x: trim(x)), lambda x: x <> '' AND NOT contains(x, ' ') AND NOT regexp_full_match(x, '(?i){signals.FILE}')),
    regexp_extract_all(query, '{signals.CAMEL}'), list_filter(regexp_extract_all(query, '{signals.SNAKE}'), lambda x: length(x) >= 3)) AS names FROM i)
SELECT query_id, array_to_string(files, ' ') AS files, array_to_string({_ordered("list_filter(names, lambda x: NOT list_contains(files, x))")}, ' ') AS symbols,
  trace AS stack_trace, regexp_matches(low, '{signals.ERROR_WORD}') AS error_token, {_tokens("query")} AS tokens FROM m""",
    "grep_hits": f"WITH {_HITS} SELECT query_id, path, line_no FROM hits",
    "grep_islands": f"WITH {_ISLANDS} SELECT query_id, path, start_line, end_line FROM rng",
    "grep_chunks": f"WITH {_CHUNKS} SELECT query_id, path, start_line, end_line, content, keyword_match FROM chk",
    "grep_topk": f"WITH {_TOPK} SELECT query_id, path, start_line, end_line, keyword_match FROM top",
    "path_resolve": f"""
WITH f AS (SELECT coalesce(source, 'none') || '/doc' || doc_id || '.md' AS path FROM documents WHERE length(text) > 0
  UNION ALL SELECT 'geo/n' || n_nationkey || '.py' FROM nation UNION ALL SELECT 'geo/r' || r_regionkey || '.py' FROM region UNION ALL SELECT 'web/s' || s_suppkey || '.ts' FROM supplier
  UNION ALL SELECT 'web/p' || p_partkey || '.ts' FROM part UNION ALL SELECT 'geo/__init__.py')
SELECT DISTINCT query_id, path FROM f JOIN {_MENTIONED} ON suffix(path, mention) OR string_split(path, '/')[-1] = string_split(mention, '/')[-1]""",
    "anchor_rank": rf"""
WITH {_TOPK},
g AS (SELECT query_id, path, max(keyword_match) AS kw, count(*) AS spans FROM top GROUP BY query_id, path),
t AS (SELECT query_id, list(DISTINCT lower(kw)) AS terms FROM kws GROUP BY query_id),
o AS (SELECT g.*, len(list_intersect(terms, list_distinct(regexp_extract_all(lower(regexp_replace(path, '([^/])\.[^./]+$', '\1')), '{T.PATH_WORD}')))) AS overlap FROM g JOIN t USING (query_id)),
r AS (SELECT *, kw + overlap * CAST(1.5 AS DOUBLE) + least(spans, 3) * CAST(0.25 AS DOUBLE) AS raw FROM o),
p AS (SELECT query_id, path, round(raw, 4) AS score, coalesce(nullif(concat_ws(', ', CASE WHEN kw <> 0 THEN 'query keyword matches' END, CASE WHEN overlap > 0 THEN 'path terms match query' END), ''), 'retrieval candidate') AS reason FROM r WHERE raw >= 1)
SELECT * FROM (SELECT query_id, path, score, reason, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS place FROM p) WHERE place <= 3""",
    "symbol_spans_py": f"WITH {_GENERATED} SELECT path, ord, start_line, end_line, name FROM spans WHERE path LIKE '%.py'",
    "symbol_spans_brace": f"WITH {_GENERATED} SELECT path, ord, start_line, end_line, name FROM spans WHERE path LIKE '%.ts'",
    "symbol_lookup": f"""
WITH {_GENERATED},
f AS (SELECT m.query_id, s.path, m.symbol, s.name, s.start_line, s.end_line, row_number() OVER (PARTITION BY query_id, path, symbol ORDER BY s.name <> m.symbol, ord) AS n FROM spans s JOIN {_MENTIONS} ON lower(s.name) = lower(m.symbol))
SELECT query_id, path, symbol, name, start_line, end_line FROM f WHERE n = 1""",
    "import_edges": f"WITH {_EDGES} SELECT src, ord, dst FROM edges",
    "import_hops": f"""
WITH RECURSIVE {_EDGES},
s AS (SELECT 1 AS query_id, 'web/p' || p_partkey || '.ts' AS path FROM part UNION ALL SELECT 2, 'geo/n' || n_nationkey || '.py' FROM nation),
h AS (SELECT query_id, path, 0 AS hop FROM s UNION SELECT query_id, dst, hop + 1 FROM h JOIN edges ON path = src WHERE hop < 2)
SELECT query_id, path, min(hop) AS hop FROM h GROUP BY query_id, path HAVING min(hop) > 0""",
    "rank_score": f"WITH {_SCORED} SELECT query_id, path, path_mention, round(recency, 9) AS recency, score, reason FROM c2",
    "optional_cap_filter": f"""
WITH {_SCORED},
k AS (SELECT *, path_mention >= 1 OR tier IN ('symbol', 'inferred_anchor', 'anchor') AS is_must FROM c2),
n AS (SELECT *, NOT is_must AND score >= CAST(0.15 AS DOUBLE) AS able FROM k),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id, able ORDER BY score DESC, tier_rank, encode(path)) AS n FROM n)
SELECT query_id, path, is_must, is_must OR (able AND n <= query_id % 4 + 1) AS kept FROM w""",
    "budget_rules": f"""
WITH b AS (SELECT *, {_SNAP.format(", ".join(map(str, BUCKETS)), "o_orderkey % 17000")} AS bucket, CAST(trunc(o_totalprice / 16) AS INT) AS must FROM orders),
f AS (SELECT *, CASE WHEN floor(bucket * CAST(1.5 AS DOUBLE)) >= must THEN bucket ELSE coalesce(list_filter([{", ".join(map(str, BUCKETS))}], lambda x: x > bucket AND floor(x * CAST(1.5 AS DOUBLE)) >= must)[1], 15000) END AS fitted,
  2 + CASE WHEN bucket >= 8000 THEN 1 ELSE 0 END + CASE WHEN o_custkey % 6 >= 4 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 60 >= 40 THEN 1 ELSE 0 END AS n FROM b)
SELECT o_orderkey, bucket, fitted, greatest(1, least(4, CASE WHEN bucket < 6000 THEN least(n, 2) ELSE n END)) AS cap FROM f""",
    "must_token_estimate": f"""
WITH {_SIZES},
a AS (SELECT DISTINCT query_id, path FROM sizes JOIN {_MENTIONED} ON suffix(path, mention) OR string_split(path, '/')[-1] = string_split(mention, '/')[-1])
SELECT query_id, CAST(sum(CASE WHEN path = 'geo/n3.py' THEN greatest(length('@tag' || chr(10) || 'def load_n3(x):' || chr(10) || '    return x') // 4, 0) ELSE greatest(1, head // 4) END) AS BIGINT) AS must_tokens FROM a JOIN sizes USING (path) GROUP BY query_id""",
    "pack_greedy": """
WITH RECURSIVE it AS (
  SELECT o_custkey AS query_id, 'p' || (o_orderkey % 3) AS path, CAST(o_orderkey % 50 + 1 AS INT) AS a, CAST(o_orderkey % 50 + 6 AS INT) AS b, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS k,
    CAST((12 + o_orderkey % 400 + 40) // 4 AS INT) AS tokens, round(o_totalprice / 500000, 4) AS score, o_orderstatus = 'F' AS must FROM orders
),
ord AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT must, -score, path, a, b, k) AS j FROM it),
f AS (
  SELECT query_id, 0 AS j, CAST(query_id % 300 + 120 AS INT) AS lim, 0 AS used, CAST([] AS STRUCT(path VARCHAR, a INT, b INT, k VARCHAR)[]) AS chosen FROM (SELECT DISTINCT query_id FROM it)
  UNION ALL
  SELECT f.query_id, o.j, f.lim, CASE WHEN t.take THEN f.used + o.tokens ELSE f.used END, CASE WHEN t.take THEN list_append(f.chosen, {'path': o.path, 'a': o.a, 'b': o.b, 'k': o.k}) ELSE f.chosen END
  FROM f JOIN ord o ON o.query_id = f.query_id AND o.j = f.j + 1,
    LATERAL (SELECT len(list_filter(f.chosen, lambda c: c.path = o.path AND NOT (o.b < c.a OR o.a > c.b))) = 0 AND CASE WHEN o.must THEN len(f.chosen) = 0 OR f.used + o.tokens <= floor(f.lim * CAST(1.5 AS DOUBLE)) ELSE f.used + o.tokens <= f.lim END AS take) t
)
SELECT query_id, CAST(lim AS BIGINT) AS budget_limit, CAST(used AS BIGINT) AS budget_used, array_to_string(list_transform(chosen, lambda c: c.k), ',') AS chosen
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY j DESC) AS last FROM f) WHERE last = 1""",
    "event_features": f"""
WITH {_intent(_TURNS)},
r AS (SELECT CAST(count(*) AS DOUBLE) AS n, round(log10(sum(length(text) - length(replace(text, chr(10), '')) + 1) + 1), 6) AS loc FROM documents WHERE length(text) > 0)
SELECT query_id, CAST({_tokens("query")} AS DOUBLE) AS query_tokens, round(log10({_tokens("query")} + 1), 6) AS query_token_log, CAST(0 AS DOUBLE) AS mentioned_files, CAST(0 AS DOUBLE) AS mentioned_symbols,
  CAST(0 AS DOUBLE) AS retrieval_signal_count, CAST(CASE WHEN trace THEN 1 ELSE 0 END AS DOUBLE) AS has_stack_trace, CAST(CASE WHEN regexp_matches(low, '{signals.ERROR_WORD}') THEN 1 ELSE 0 END AS DOUBLE) AS has_error_token,
  confidence AS intent_confidence, CAST({_budget(0)} AS DOUBLE) AS intent_budget, r.n AS repo_file_count, r.loc AS repo_loc_log, CAST(0 AS DOUBLE) AS discovered_anchor_count, CAST(0 AS DOUBLE) AS must_include_token_estimate,
  {", ".join(f"CAST(CASE WHEN intent = '{k}' THEN 1 ELSE 0 END AS DOUBLE) AS intent_{k}" for k in INTENT_BUDGETS)}
FROM i, r""",
    "repo_stats": "WITH r AS (SELECT count(*) AS file_count, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS total_lines FROM documents WHERE length(text) > 0) SELECT file_count, total_lines, round(log10(total_lines + 1), 9) AS loc_log FROM r",
    "manifest_stale": f"""
WITH {_FILES}
SELECT path AS rel_path, CASE WHEN doc_id % 13 = 0 THEN 'new' WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'time' ELSE 'size' END AS reason FROM files
WHERE CASE WHEN doc_id % 13 = 0 THEN doc_id % 11 <> 0 ELSE doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0 END""",
    "manifest_stored": f"""
WITH {_FILES}
SELECT path, CAST(doc_id AS BIGINT) * 1000000000 AS mtime_ns, CAST(strlen(content) AS BIGINT) AS size, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT) AS line_count, CAST(len({_lines("content")}) AS BIGINT) AS n_lines
FROM files WHERE doc_id % 13 <> 0""",
    "composite_search": rf"""
WITH {_TOPK},
first80 AS (SELECT path, lines FROM fl ORDER BY path LIMIT 80),
win AS (SELECT path, lines, unnest(range(1, greatest(1, CAST(ceil((len(lines) - 24) / 12.0) AS BIGINT) * 12 + 1) + 1, 12)) AS a FROM first80),
wins AS (SELECT path, a, least(len(lines), a + 23) AS b, array_to_string(lines[a:least(len(lines), a + 23)], chr(10)) AS content FROM win),
vec AS (SELECT *, {_LETTERS.format("content")} AS v FROM wins WHERE regexp_matches(content, '\S')),
ask AS (SELECT query_id, {_LETTERS.format("query")} AS q FROM {_BATCH} WHERE trim(query) <> ''),
sim AS (SELECT query_id, path, a, b, content, coalesce(CASE WHEN isnan(list_cosine_similarity(q, v)) THEN 0 ELSE list_cosine_similarity(q, v) END, 0) AS s FROM ask, vec),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, path, a, b, content) AS n FROM sim) WHERE n <= 20),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_match DESC, path, start_line) AS k FROM chk) WHERE k <= 20),
sides AS (
  SELECT query_id, 0 AS side, 'grep' AS tier, path, start_line, end_line, keyword_match AS m FROM best
  UNION ALL SELECT query_id, 1, 'embedding', path, a, b, s FROM near
),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY m DESC, path, start_line) AS place FROM sides),
new AS (SELECT *, row_number() OVER (PARTITION BY query_id, path, start_line, end_line ORDER BY side, place) AS nth FROM placed),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY side, place) AS k FROM new WHERE side = 0 OR nth = 1)
SELECT query_id, tier, path, start_line, end_line, round(m, 6) AS keyword_match FROM merged WHERE k <= 20""",
    "scan_filter": "SELECT page_id, page_id % 4 NOT IN (1, 2) AND page_id % 5 IN (0, 2, 4) AND length(html) * 90 <= 524288 AS scanned FROM pages",
    "line_windows": rf"""
WITH {_FILES},
l AS (SELECT path, {_lines("content")} AS lines FROM files),
w AS (SELECT path, lines, unnest(range(1, greatest(1, CAST(ceil((len(lines) - 24) / 12.0) AS BIGINT) * 12 + 1) + 1, 12)) AS start_line FROM l),
c AS (SELECT path, start_line, least(len(lines), start_line + 23) AS end_line, array_to_string(lines[start_line:least(len(lines), start_line + 23)], chr(10)) AS content FROM w)
SELECT path, start_line, end_line, length(content) AS chars FROM c WHERE regexp_matches(content, '\S')""",
    "cosine_topk": """
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 0) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS n FROM s)
SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM n WHERE n <= 5""",
    "merge_hits": """
WITH o AS (SELECT o_custkey AS query_id, o_orderkey, o_totalprice, o_orderkey % 2 AS side, 'p' || (o_orderkey % 4) AS path, o_orderkey % 9 AS place_at FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY o_totalprice DESC, o_orderkey) AS place FROM o),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, path, place_at ORDER BY side, place) AS nth FROM r),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY side, place) AS merged_rank FROM f WHERE side = 0 OR nth = 1)
SELECT query_id, merged_rank, o_orderkey FROM m WHERE merged_rank <= 6""",
    "stream_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(round(sum(value), 4), 2) AS total FROM events GROUP BY ALL",
    "stream_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, s.n""",
}

#: Columns that are 64-bit in Spark and that DuckDB takes for 32-bit ones.
_LONG = {
    "intent_classify": ("recommended", "least", "most"),
    "symbol_spans_py": ("ord", "start_line", "end_line"),
    "symbol_spans_brace": ("ord", "start_line", "end_line"),
    "symbol_lookup": ("query_id", "start_line", "end_line"),
    "import_edges": ("ord",),
    "import_hops": ("query_id", "hop"),
    "budget_rules": ("bucket", "fitted", "cap"),
    "composite_search": ("query_id", "start_line", "end_line"),
    **{k: ("query_id",) for k in ("query_signals", "grep_hits", "grep_islands", "grep_chunks", "grep_topk", "path_resolve", "anchor_rank", "must_token_estimate")},
}
for _name, _columns in _LONG.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _columns)}) FROM ({SQL[_name]})"
