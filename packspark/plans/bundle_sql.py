"""DuckDB SQL of whole bundles: candidates of all tiers, scores, packing, expansion, rendering, events."""

from __future__ import annotations

from packspark.functions import signals
from packspark.operators.budget import BUCKETS
from packspark.plans.oracles import _BATCH, _EDGES, _FILES, _GENERATED, _MENTIONED, _TOPK, _budget, _intent, _lines, _tokens

#: Which symbols the batch mentions, in order, as (query_id, ord, symbol): found by eye.
_WANTED = "(VALUES (2, 1, 'worthless'), (2, 2, 'trashTalk'), (3, 1, 'scum_loser'), (5, 1, 'disgustingStupid'), (8, 1, 'Nation7'), (8, 2, 'load_n3')) AS w(query_id, ord, symbol)"
#: The file mentions of the batch as they stand in it.
_RAW_MENTIONS = "(VALUES (1, 1, 'src3/doc12.md'), (1, 2, './doc7.md'), (4, 1, 'src1/doc40.md'), (8, 1, 'geo/n3.py'), (8, 2, 'web/p5.ts'), (8, 3, 'web/s2.ts')) AS r(query_id, ord, mention)"
_NL = "chr(10)"


def _text(*lines: str) -> str:
    """A text of lines, each ended, whose {x} are SQL expressions."""
    parts = []
    for line in lines:
        head, *rest = line.split("{")
        pieces = [f"'{head}'"]
        for piece in rest:
            expr, tail = piece.split("}", 1)
            pieces += [expr, f"'{tail}'"]
        parts.append(" || ".join(pieces))
    return f" || {_NL} || ".join(parts) + f" || {_NL}"


_CODE = f"""
SELECT 'geo/n' || n_nationkey || '.py' AS path, CAST(0 AS DOUBLE) AS mtime, {_text("import geo.r{n_regionkey}", "from . import shared", "", "@tag", "def load_n{n_nationkey}(x):", "    return x", "", "class Nation{n_nationkey}:", "    def total(self):", "        return 1")} AS content FROM nation
UNION ALL SELECT 'geo/r' || r_regionkey || '.py', 0, {_text("REGION = ''{r_name}''")} FROM region
UNION ALL SELECT 'web/s' || s_suppkey || '.ts', 0, {_text("export class Supplier{s_suppkey} {chr(123)}", "  pay(amount) {chr(123)}", "    return amount;", "  {chr(125)}", "{chr(125)}")} FROM supplier
UNION ALL SELECT 'web/p' || p_partkey || '.ts', 0, {_text("import {chr(123)} Supplier {chr(125)} from ''./s{p_partkey % 10}'';", "export function loadPart{p_partkey}(a) {chr(123)}", "  if (a) {chr(123)}", "    return 1;", "  {chr(125)}", "{chr(125)}")} FROM part
UNION ALL SELECT 'geo/__init__.py', 0, 'shared = 1' || {_NL}"""
_ALL_FILES = f"files AS (SELECT coalesce(source, 'none') || '/doc' || doc_id || '.md' AS path, CAST(doc_id AS DOUBLE) AS mtime, text AS content FROM documents WHERE length(text) > 0 UNION ALL {_CODE})"
_HEAD = "array_to_string(lines[1:{0}], chr(10)) AS content, 1 AS a, greatest(1, least(len(lines), {0})) AS b"
_NAMED = "suffix(path, mention) OR string_split(path, '/')[-1] = string_split(mention, '/')[-1]"
_FEATURES = """SELECT c.* REPLACE ({mention} AS pm), (mtime - min(mtime) OVER w) / CASE WHEN max(mtime) OVER w > min(mtime) OVER w THEN max(mtime) OVER w - min(mtime) OVER w ELSE 1 END AS recency
  FROM {rows} c JOIN files USING (path) {join} WINDOW w AS (PARTITION BY c.query_id)"""


def _packed(name: str, found: str, limits: str) -> str:
    """CTEs that rank, keep and pack candidates of ``found`` under ``limits`` (query_id, lim, anchors,
    tokens): the table ``name`` has query_id, lim, used, chosen, everything, optional."""
    n = name
    return f"""
{n}_s AS (SELECT *, CASE WHEN max(kw) OVER w > 0 THEN kw / max(kw) OVER w ELSE 0 END AS nkw FROM {found} WINDOW w AS (PARTITION BY query_id)),
{n}_r AS (SELECT *, round(CAST(0.4 AS DOUBLE) * nkw + CAST(0.3 AS DOUBLE) * least(1, pm) + CAST(0.2 AS DOUBLE) * least(1, ip) + CAST(0.1 AS DOUBLE) * least(1, recency), 4) AS score,
  coalesce(nullif(concat_ws(', ', CASE WHEN pm > 0 THEN 'explicitly mentioned path' END, CASE tier WHEN 'symbol' THEN 'symbol slice' WHEN 'import' THEN 'import neighbor' WHEN 'inferred_anchor' THEN 'inferred anchor' END,
    CASE WHEN kw > 0 AND tier = 'grep' THEN 'keyword match' END, CASE WHEN ip > 0 AND tier <> 'import' THEN 'near anchor in import graph' END), ''), 'candidate') AS reason,
  pm >= 1 OR tier IN ('symbol', 'inferred_anchor', 'anchor') AS must FROM {n}_s),
{n}_c AS (SELECT *, greatest(1, least(4, CASE WHEN lim < 6000 THEN least(n, 2) ELSE n END)) AS cap FROM (SELECT *, 2 + CASE WHEN lim >= 8000 THEN 1 ELSE 0 END + CASE WHEN anchors >= 4 THEN 1 ELSE 0 END + CASE WHEN tokens >= 40 THEN 1 ELSE 0 END AS n FROM {limits})),
{n}_n AS (SELECT *, NOT must AND score >= CAST(0.15 AS DOUBLE) AS able FROM {n}_r),
{n}_w AS (SELECT *, row_number() OVER (PARTITION BY query_id, able ORDER BY score DESC, tier_rank, path, a, b, content) AS nth FROM {n}_n),
{n}_k AS (SELECT *, must OR (able AND nth <= cap) AS kept FROM {n}_w JOIN {n}_c USING (query_id)),
{n}_o AS (SELECT *, {_tokens("content")} AS size, row_number() OVER (PARTITION BY query_id ORDER BY NOT must, -score, tier_rank, path, a, b, content) AS j FROM {n}_k WHERE kept),
{n}_f AS (
  SELECT query_id, 0 AS j, CAST(lim AS INT) AS lim, 0 AS used, CAST([] AS STRUCT(path VARCHAR, a INT, b INT, content VARCHAR, score DOUBLE, reason VARCHAR, tokens INT)[]) AS chosen FROM {limits}
  UNION ALL
  SELECT f.query_id, o.j, f.lim, CAST(CASE WHEN t.take THEN f.used + o.size ELSE f.used END AS INT),
    CASE WHEN t.take THEN list_append(f.chosen, {{'path': o.path, 'a': CAST(o.a AS INT), 'b': CAST(o.b AS INT), 'content': o.content, 'score': o.score, 'reason': o.reason, 'tokens': CAST(o.size AS INT)}}) ELSE f.chosen END
  FROM {n}_f f JOIN {n}_o o ON o.query_id = f.query_id AND o.j = f.j + 1,
    LATERAL (SELECT len(list_filter(f.chosen, lambda c: c.path = o.path AND NOT (o.b < c.a OR o.a > c.b))) = 0 AND CASE WHEN o.must THEN len(f.chosen) = 0 OR f.used + o.size <= floor(f.lim * CAST(1.5 AS DOUBLE)) ELSE f.used + o.size <= f.lim END AS take) t
),
{n} AS (
  SELECT query_id, lim, used, chosen, coalesce(number, 0) AS number, coalesce(optional, 0) AS optional
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY j DESC) AS last FROM {n}_f) LEFT JOIN (SELECT query_id, count(*) AS number, count(*) FILTER (kept AND NOT must) AS optional FROM {n}_k GROUP BY query_id) USING (query_id) WHERE last = 1
)"""


def _chunks(bundles: str) -> str:
    return f"""
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(pos AS INT) AS pos, c.path AS path, c.a AS start_line, c.b AS end_line, c.content AS content, c.score AS score, c.reason AS reason, c.tokens AS tokens
FROM (SELECT query_id, unnest(chosen) AS c, generate_subscripts(chosen, 1) AS pos FROM {bundles})"""


_BUCKETS = ", ".join(map(str, BUCKETS))
_STATE = rf"""
WITH RECURSIVE {_TOPK.replace(_FILES, _ALL_FILES)},
{_GENERATED}, {_EDGES}, {_intent(f"SELECT query_id, query FROM {_BATCH}")},
ag AS (SELECT query_id, path, max(keyword_match) AS kw, count(*) AS n FROM top GROUP BY query_id, path),
terms AS (SELECT query_id, list(DISTINCT lower(kw)) AS terms FROM kws GROUP BY query_id),
ao AS (SELECT ag.*, kw + CAST(1.5 AS DOUBLE) * len(list_intersect(terms, list_distinct(regexp_extract_all(lower(regexp_replace(path, '([^/])\.[^./]+$', '\1')), '[A-Za-z_][A-Za-z0-9_]{{1,}}')))) + least(n, 3) * CAST(0.25 AS DOUBLE) AS raw FROM ag JOIN terms USING (query_id)),
ab AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 4) DESC, path) AS place FROM ao WHERE raw >= 1),
explicit AS (SELECT DISTINCT query_id, path FROM files JOIN {_MENTIONED} ON {_NAMED}),
inferred AS (SELECT query_id, path FROM ab WHERE place <= 3 AND (query_id, path) NOT IN (SELECT (query_id, path) FROM explicit)),
both_ AS (SELECT * FROM explicit UNION ALL SELECT * FROM inferred),
look AS (SELECT * FROM (SELECT w.query_id, s.path, start_line AS a, end_line AS b, row_number() OVER (PARTITION BY w.query_id, s.path, symbol ORDER BY s.name <> symbol, s.ord) AS n FROM spans s JOIN {_WANTED} ON lower(s.name) = lower(symbol)) WHERE n = 1),
sliced AS (SELECT query_id, path, a, b, array_to_string(lines[a:b], chr(10)) AS content, (query_id, path) IN (SELECT (query_id, path) FROM explicit) AS own, (query_id, path) IN (SELECT (query_id, path) FROM both_) AS anchor FROM look JOIN fl USING (path)),
found AS (
  SELECT query_id, 0 AS tier_rank, path, a, b, content, 'symbol' AS tier, CAST(1 AS DOUBLE) AS kw, CAST(1 AS DOUBLE) AS pm, CAST(0 AS DOUBLE) AS ip FROM sliced WHERE own
  UNION ALL SELECT query_id, 0, path, h.a, h.b, h.content, 'anchor', 0, 1, 0 FROM (SELECT query_id, path, {_HEAD.format(40)} FROM explicit JOIN fl USING (path)) h WHERE (query_id, path) NOT IN (SELECT (query_id, path) FROM sliced WHERE own)
  UNION ALL SELECT query_id, 1, path, h.a, h.b, h.content, 'inferred_anchor', 0, CAST(0.75 AS DOUBLE), 0 FROM (SELECT query_id, path, {_HEAD.format(40)} FROM inferred JOIN fl USING (path)) h
  UNION ALL SELECT query_id, 2, path, a, b, content, 'symbol', 1, 0, CAST(0.5 AS DOUBLE) FROM sliced WHERE NOT anchor
  UNION ALL SELECT query_id, 3, path, h.a, h.b, h.content, 'import', 0, 0, CAST(0.7 AS DOUBLE) FROM (SELECT query_id, path, {_HEAD.format(18)} FROM (SELECT DISTINCT query_id, dst AS path FROM both_ JOIN edges ON path = src) JOIN fl USING (path)) h
  UNION ALL SELECT query_id, 4, path, start_line, end_line, content, 'grep', keyword_match, 0, 0 FROM top
),
cand AS ({_FEATURES.format(rows="found", mention="CASE WHEN pm = 0 AND x.path IS NOT NULL THEN CAST(0.5 AS DOUBLE) ELSE pm END", join="LEFT JOIN both_ x ON x.query_id = c.query_id AND x.path = c.path")}),
number AS (SELECT query_id, count(*) AS anchors FROM both_ GROUP BY query_id),
heads AS (SELECT query_id, path, content FROM (SELECT query_id, path, {_HEAD.format(40)} FROM both_ JOIN fl USING (path))),
must1 AS (SELECT h.query_id, h.path, max({_tokens("h.content")}) AS head, max({_tokens("s.content")}) AS slice FROM heads h LEFT JOIN sliced s ON s.query_id = h.query_id AND s.path = h.path GROUP BY h.query_id, h.path),
must2 AS (SELECT query_id, sum(coalesce(nullif(slice, 0), head)) AS must FROM must1 GROUP BY query_id),
lims AS (SELECT i.query_id, coalesce(anchors, 0) AS anchors, {_tokens("query")} AS tokens, CASE WHEN coalesce(must, 0) <= 12000 THEN 8000 ELSE coalesce(list_filter([{_BUCKETS}], lambda x: x > 8000 AND floor(x * CAST(1.5 AS DOUBLE)) >= must)[1], 15000) END AS lim
  FROM i LEFT JOIN number USING (query_id) LEFT JOIN must2 USING (query_id)),
{_packed("bundle", "cand", "lims")}"""

_EXPANDED = f"""{_STATE},
asked(query_id, focus, extra) AS (VALUES (1, 'src3/doc13.md', CAST(NULL AS INT)), (8, NULL, 500)),
old AS (SELECT * FROM cand WHERE query_id IN (SELECT query_id FROM asked)),
hop AS (SELECT DISTINCT o.query_id, dst AS path FROM old o JOIN edges ON o.path = src WHERE (o.query_id, dst) NOT IN (SELECT (query_id, path) FROM old)),
fresh AS (
  SELECT query_id, 0 AS tier_rank, path, 1 AS a, greatest(1, len(lines)) AS b, content, 'anchor' AS tier, CAST(0 AS DOUBLE) AS kw, CAST(1 AS DOUBLE) AS pm, CAST(0 AS DOUBLE) AS ip FROM (SELECT DISTINCT query_id, path, lines, content FROM files JOIN fl USING (path) JOIN (SELECT query_id, focus AS mention FROM asked WHERE focus <> '') ON {_NAMED})
  UNION ALL SELECT query_id, 3, path, h.a, h.b, h.content, 'import', 0, 0, CAST(0.4 AS DOUBLE) FROM (SELECT query_id, path, {_HEAD.format(40)} FROM hop JOIN fl USING (path)) h
),
timed AS ({_FEATURES.format(rows="fresh", mention="pm", join="")}),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path, a, b ORDER BY tier_rank) AS nth FROM timed) WHERE nth = 1 AND (query_id, path, a, b) NOT IN (SELECT (query_id, path, a, b) FROM old)),
more AS (SELECT * FROM old UNION ALL SELECT * EXCLUDE (nth) FROM once),
wide AS (SELECT query_id, CAST(lim + coalesce(nullif(extra, 0), floor(lim * CAST(0.5 AS DOUBLE))) AS INT) AS lim, tokens, (SELECT count(*) FROM {_RAW_MENTIONS} WHERE r.query_id = lims.query_id) + (SELECT count(*) FROM inferred x WHERE x.query_id = lims.query_id) AS anchors FROM lims JOIN asked USING (query_id)),
{_packed("wider", "more", "wide")}"""

_ID = "md5('bundle:' || query_id)"
_END = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"
_TICKS = "chr(96) || chr(96) || chr(96)"
_MESSAGE = rf"""{_STATE},
names AS (SELECT query_id, list(name ORDER BY side, ord) AS named FROM (SELECT query_id, 0 AS side, ord, mention AS name FROM {_RAW_MENTIONS} UNION ALL SELECT query_id, 1, ord, symbol FROM {_WANTED}) GROUP BY query_id),
guesses AS (SELECT query_id, list(path ORDER BY path) AS paths FROM inferred GROUP BY query_id),
secs AS (SELECT query_id, string_agg('## Chunk ' || pos || ': ' || chr(96) || path || chr(96) || ' L' || start_line || '-L' || end_line || chr(10) || '*score ' || printf('%.2f', CAST(round(CAST(score AS DECIMAL(10, 4)), 2) AS DOUBLE)) || ' — ' || reason || ' (' || tokens || ' tokens)*' || chr(10) || chr(10) || {_TICKS} || chr(10) || regexp_replace(content, '{_END}', '') || chr(10) || {_TICKS} || chr(10), chr(10) ORDER BY pos) AS body FROM ({_chunks("bundle")}) GROUP BY query_id)
SELECT CAST(query_id AS BIGINT) AS query_id, regexp_replace(array_to_string(list_filter([
  '# Budgeted codebase context', '', '**Query:** ' || query, '**Workspace:** /workspace', '**Intent:** ' || intent || ' (confidence ' || CAST(round(confidence * 100) AS INT) || '%)',
  '**Budget:** ' || format('{{:,}}', used) || ' / ' || format('{{:,}}', lim) || ' tokens (' || len(chosen) || ' chunks)', '**Bundle id:** ' || chr(96) || {_ID} || chr(96), '',
  'Use only the chunks below to answer or continue the task.', 'Do not read whole files unless a chunk is clearly insufficient.', 'If more context is needed, call ' || chr(96) || 'expand_context' || chr(96) || ' with bundle id ' || chr(96) || {_ID} || chr(96) || '.', '',
  CASE WHEN named IS NOT NULL THEN '**Anchors:** ' || array_to_string(named, ', ') END, CASE WHEN paths IS NOT NULL THEN '**Inferred anchors:** ' || array_to_string(paths, ', ') END, CASE WHEN named IS NOT NULL OR paths IS NOT NULL THEN '' END,
  body, '## Excluded', '', (number - len(chosen)) || ' candidates dropped (below score threshold or over budget)', ''
], lambda x: x IS NOT NULL), chr(10)), '{_END}', '') || chr(10) AS message
FROM bundle JOIN i USING (query_id) LEFT JOIN names USING (query_id) LEFT JOIN guesses USING (query_id) LEFT JOIN secs USING (query_id)"""

_EVENTS = f"""{_STATE},
sizes AS (SELECT query_id, CAST((SELECT count(*) FROM {_RAW_MENTIONS} WHERE r.query_id = i.query_id) AS INT) AS mentioned_files, CAST((SELECT count(*) FROM {_WANTED} WHERE w.query_id = i.query_id) AS INT) AS mentioned_symbols,
  CAST((SELECT count(*) FROM inferred x WHERE x.query_id = i.query_id) AS INT) AS inferred_files, trace AS has_stack_trace, regexp_matches(low, '{signals.ERROR_WORD}') AS has_error_token FROM i),
rows_ AS (
  SELECT 'analyze_query' AS event, CAST(query_id AS VARCHAR) AS id, query_id, {_budget(0)} AS budget_assigned, 0 AS budget_used, 0 AS chunk_count, CAST(NULL AS BIGINT) AS grep_hits, CAST(NULL AS VARCHAR) AS budget_source FROM i
  UNION ALL SELECT 'get_context_bundle', {_ID}, query_id, lim, used, len(chosen), number, 'fallback_default' FROM bundle
)
SELECT event, id AS query_id, CAST({_tokens("query")} AS INT) AS query_tokens, intent, confidence AS intent_confidence, CAST(budget_assigned AS INT) AS budget_assigned, CAST(budget_used AS INT) AS budget_used, CAST(chunk_count AS INT) AS chunk_count, CAST(0 AS INT) AS expansions,
  s.mentioned_files, s.mentioned_symbols, s.inferred_files, s.has_stack_trace, s.has_error_token, CAST(grep_hits AS INT) AS grep_hits, CAST(NULL AS BOOLEAN) AS success, budget_source
FROM rows_ JOIN i USING (query_id) JOIN sizes s USING (query_id)"""

SQL: dict[str, str] = {
    "bundle_e2e": f"{_STATE} {_chunks('bundle')}",
    "expand_e2e": f"{_EXPANDED} {_chunks('wider')}",
    "render_context": _MESSAGE,
    "bundle_log": _EVENTS,
    "engine_requests": f"""{_EXPANDED}
SELECT 'analyze' AS request, CAST(query_id AS BIGINT) AS query_id, intent AS answer FROM i WHERE query_id <= 4
UNION ALL SELECT 'tokens', query_id, CAST({_tokens("query")} AS VARCHAR) FROM i WHERE query_id <= 4
UNION ALL SELECT 'bundle', 1, used || '/' || lim || '/' || len(chosen) || '/0' FROM bundle WHERE query_id = 1
UNION ALL SELECT 'files', 1, string_agg(mention, ' ' ORDER BY ord) FROM {_RAW_MENTIONS} WHERE query_id = 1
UNION ALL SELECT 'estimate', 1, CAST(used AS VARCHAR) FROM bundle WHERE query_id = 1
UNION ALL SELECT 'owner', 1, 'true'
UNION ALL SELECT 'expand', 1, used || '/' || lim || '/' || len(chosen) || '/1' FROM wider WHERE query_id = 1
UNION ALL SELECT 'unknown', 1, 'unknown bundle id'""",
}
