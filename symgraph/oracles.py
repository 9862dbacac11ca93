"""The fixture graph in DuckDB's SQL, and the query oracles."""

from __future__ import annotations

from symgraph.fixture import SNIPPETS

NID = "{f} || '::' || {n} || ':' || CAST({l} AS VARCHAR)"

GRAPH = r"""
WITH RECURSIVE fn AS (
  SELECT 'part/' || p_brand || '.ts::' || p_name || ':' || p_partkey AS id, 'function' AS kind, p_name AS name, 'part/' || p_brand || '.ts' AS file,
    CAST(p_partkey AS INTEGER) AS start_line, CAST(p_partkey + p_size AS INTEGER) AS end_line, sha256(p_brand) AS content_hash, p_partkey, p_size FROM part
), md AS (
  SELECT 'part/' || p_brand || '.ts::part/' || p_brand || '.ts:1' AS id, 'module' AS kind, 'part/' || p_brand || '.ts' AS name, 'part/' || p_brand || '.ts' AS file,
    1 AS start_line, CAST(max(p_partkey + p_size) AS INTEGER) AS end_line, sha256(p_brand) AS content_hash FROM part GROUP BY p_brand
), cl AS (
  SELECT 'supplier/' || s_nationkey || '.ts::' || s_name || ':' || s_suppkey AS id, 'class' AS kind, s_name AS name, 'supplier/' || s_nationkey || '.ts' AS file,
    CAST(s_suppkey AS INTEGER) AS start_line, CAST(NULL AS INTEGER) AS end_line, sha256(s_name) AS content_hash, s_nationkey FROM supplier
), itf AS (
  SELECT 'geo/nation.ts::' || n_name || ':' || n_nationkey AS id, 'interface' AS kind, n_name AS name, 'geo/nation.ts' AS file,
    n_nationkey AS start_line, n_nationkey AS end_line, sha256('geo') AS content_hash, n_nationkey FROM nation
), ev AS (
  SELECT *, 'endpoint:' || upper(event_type) || ':/u/' || (user_id % 10) AS eid, epoch_us(ts) // 1000 AS ms FROM events
), ep AS (
  SELECT eid AS id, 'endpoint' AS kind, eid AS name, 'events.ts' AS file, CAST(min(event_id) + 1 AS INTEGER) AS start_line,
    CAST(min(event_id) + 1 AS INTEGER) AS end_line, sha256('events') AS content_hash FROM ev GROUP BY eid
), nodes AS (
  SELECT id, kind, name, file, start_line, end_line, content_hash FROM fn UNION ALL SELECT * FROM md
  UNION ALL SELECT id, kind, name, file, start_line, end_line, content_hash FROM cl
  UNION ALL SELECT id, kind, name, file, start_line, end_line, content_hash FROM itf UNION ALL SELECT * FROM ep
), li AS (
  SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS nxt FROM lineitem
), raw AS (
  SELECT s.id AS source, t.id AS target, 'calls' AS kind,
    CASE l_returnflag WHEN 'A' THEN 'tree-sitter' WHEN 'N' THEN 'lsp' ELSE 'agent' END AS provenance_source,
    CAST(CASE l_returnflag WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence,
    t.name || ':' || l_orderkey || ':' || l_linenumber AS evidence, s.content_hash, epoch_us(l_shipdate) // 1000 AS created_at,
    l_orderkey AS seq_order, CAST(l_linenumber AS BIGINT) AS seq_line, t.name AS target_name
  FROM li JOIN fn s ON s.p_partkey = l_partkey JOIN fn t ON t.p_partkey = nxt
), calls AS (
  SELECT source, target, kind, provenance_source, confidence, evidence, content_hash, created_at FROM raw
  QUALIFY row_number() OVER (PARTITION BY source, target, provenance_source ORDER BY created_at DESC, seq_order DESC, seq_line DESC) = 1
), sent_rows AS (
  SELECT source, '__unresolved__::' || target_name || ':0' AS target, 'calls' AS kind, 'tree-sitter' AS provenance_source, CAST(0.5 AS DOUBLE) AS confidence,
    evidence, content_hash, created_at, seq_order, seq_line FROM raw WHERE seq_order % 10 = 0
), sent AS (
  SELECT source, target, kind, provenance_source, confidence, evidence, content_hash, created_at FROM sent_rows
  QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY created_at, seq_order, seq_line) = 1
), impl AS (
  SELECT cl.id AS source, itf.id AS target, 'implements' AS kind, 'lsp' AS provenance_source, CAST(0.9 AS DOUBLE) AS confidence,
    itf.file || ':' || itf.start_line || ':1' AS evidence, cl.content_hash, CAST(0 AS BIGINT) AS created_at FROM cl JOIN itf ON n_nationkey = s_nationkey
), routes AS (
  SELECT fn.id AS source, eid AS target, 'routes_to' AS kind, 'ast-grep' AS provenance_source, CAST(0.9 AS DOUBLE) AS confidence,
    'route@events.ts:' || min(event_id) || ':1' AS evidence, any_value(fn.content_hash) AS content_hash, min(ms) AS created_at
  FROM ev JOIN fn ON p_partkey = event_id % 1000 GROUP BY fn.id, eid
), imps AS (
  SELECT md.id AS source, fn.id AS target, 'imports' AS kind, 'agent' AS provenance_source, CAST(0.7 AS DOUBLE) AS confidence, 'note' AS evidence,
    md.content_hash, p_partkey AS created_at FROM md JOIN fn ON md.file = fn.file AND p_size = 1
), edges AS (
  SELECT * FROM calls UNION ALL SELECT * FROM sent UNION ALL SELECT * FROM impl UNION ALL SELECT * FROM routes UNION ALL SELECT * FROM imps
), hashes AS (SELECT file, min(content_hash) AS hash FROM nodes GROUP BY file
), files AS (SELECT 'docs/' || source || '/' || doc_id || '.ts' AS file, text AS content, doc_id FROM documents
), stored AS (
  SELECT file, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(content) END AS hash FROM files WHERE doc_id % 10 <> 0
  UNION ALL SELECT 'docs/gone/' || range || '.ts', 'gone' FROM range(5)
), dnodes AS (
  SELECT f || '::d' || doc_id || ':' || (doc_id % 5 + 1) AS id, 'function' AS kind, 'd' || doc_id AS name, f AS file, CAST(doc_id % 5 + 1 AS INTEGER) AS start_line,
    CAST(doc_id % 5 + 1 AS INTEGER) AS end_line, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(content) END AS content_hash
  FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'away/' || doc_id || '.ts' ELSE file END AS f FROM files)
), centers AS (SELECT id FROM nodes
), nb AS (
  SELECT c.id AS center, 'out' AS dir, n.*, e.source, e.target, e.kind AS edge_kind, e.provenance_source, e.confidence, e.evidence, e.content_hash AS edge_hash, e.created_at
  FROM centers c JOIN edges e ON e.source = c.id JOIN nodes n ON n.id = e.target
  UNION ALL
  SELECT c.id, 'in', n.*, e.source, e.target, e.kind, e.provenance_source, e.confidence, e.evidence, e.content_hash, e.created_at
  FROM centers c JOIN edges e ON e.target = c.id JOIN nodes n ON n.id = e.source
), sec AS (
  SELECT *, CASE WHEN edge_kind = 'calls' AND target = center THEN 'Callers' WHEN edge_kind = 'calls' THEN 'Callees' ELSE 'Imports' END AS section
  FROM nb WHERE edge_kind = 'calls' OR (edge_kind = 'imports' AND source = center)
), top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY center, section ORDER BY confidence DESC, created_at DESC, dir DESC, source, target, edge_kind, provenance_source) AS INTEGER) AS rn,
    count(*) OVER (PARTITION BY center, section) AS n FROM sec
), lookups AS (
  SELECT r.file, r.line, r.col, CASE WHEN r.line % 3 <> 0 THEN f.file END AS def_file, CASE WHEN r.line % 3 <> 0 THEN f.start_line END AS def_line
  FROM (SELECT split_part(source, '::', 1) AS file, CAST(split_part(evidence, ':', 2) AS INTEGER) AS line, CAST(split_part(evidence, ':', 3) AS INTEGER) AS col, min(split_part(evidence, ':', 1)) AS name FROM sent GROUP BY 1, 2, 3) r
  JOIN (SELECT name, arg_min(file, p_partkey) AS file, arg_min(start_line, p_partkey) AS start_line FROM fn GROUP BY name) f USING (name)
), refs AS (
  SELECT a.id AS symbol_id, b.file AS ref_file, CAST(i * b.end_line / 6 - 0.5 AS INTEGER) AS l0, CAST(floor(i * b.end_line / 6) AS INTEGER) AS ref_line
  FROM (SELECT name, arg_min(id, p_partkey) AS id, arg_min(file, p_partkey) AS file, min(p_partkey) % 5 + 1 AS i FROM fn GROUP BY name) a JOIN md b ON a.file <> b.file
)
"""

_EDGE = "source, target, kind, provenance_source, confidence, evidence, content_hash, created_at"
_ROW = "center, dir, id, kind, name, file, start_line, end_line, content_hash, source, target, edge_kind, provenance_source, confidence, evidence, edge_hash, created_at"


def impact(names: str, depth: int, label: str) -> str:
    return f""", st AS (SELECT DISTINCT source AS nxt, target AS here FROM edges JOIN nodes ON id = source WHERE edges.kind = 'calls'
), bfs AS (SELECT id, 0 AS d FROM nodes WHERE name IN ({names}) UNION SELECT nxt, d + 1 FROM bfs JOIN st ON here = id WHERE d < {depth}
), hit AS (SELECT id, min(d) AS depth FROM bfs GROUP BY id HAVING min(d) > 0)
SELECT hit.id AS node_id, name, file, depth, {label} AS classification FROM hit JOIN nodes USING (id)"""


_BREAK = "CASE WHEN depth = 1 THEN 'breaking' ELSE 'behavioral' END"
_LINE = "CASE WHEN start_line BETWEEN 1 AND len(ls) THEN ls[start_line] END"
_TRIM = r"regexp_replace(regexp_replace({x}, '^[\s\x{{00A0}}\x{{FEFF}}]+', ''), '[\s\x{{00A0}}\x{{FEFF}}]+$', '')"
_SPLIT = r"regexp_split_to_array(content, '\r?\n')"
_NEAR = "sum(CASE WHEN {0} THEN 1 ELSE 0 END)"

BODY: dict[str, str] = {
    "impact_signature": impact("'red bolt'", 5, _BREAK),
    "impact_removal": impact("'red bolt'", 2, _BREAK),
    "impact_behavior": impact("'red bolt'", 2, "'behavioral'"),
    "impact_depth1": impact("'red bolt'", 1, _BREAK),
    "impact_multi": impact("'red bolt', 'blue gear', 'NATION_3'", 2, _BREAK),
    "impact_ordered": impact("'red bolt'", 2, _BREAK),
    "impact_summary": impact("'red bolt'", 2, _BREAK).replace("SELECT hit.id AS node_id", "SELECT classification, depth, count(*) AS n FROM (SELECT hit.id AS node_id") + ") GROUP BY classification, depth",
    "impact_matrix": """SELECT c AS change, CAST(d AS INTEGER) AS depth, CASE WHEN c = 'behavior_change' THEN 'behavioral' WHEN c = 'addition' THEN NULL WHEN d = 1 THEN 'breaking' ELSE 'behavioral' END AS classification
FROM (SELECT unnest(['signature_change', 'removal', 'behavior_change', 'addition']) AS c), range(1, 6) t(d)""",
    "get_node": "SELECT * FROM nodes WHERE id = (SELECT min(id) FROM nodes)",
    "find_nodes": "SELECT * FROM nodes WHERE name = 'red bolt'",
    "find_nodes_in_file": "SELECT * FROM nodes WHERE name = 'red bolt' AND file = (SELECT min(file) FROM nodes WHERE name = 'red bolt')",
    "nodes_by_file": "SELECT * FROM nodes WHERE file = 'events.ts'",
    "edges_by_source": f"SELECT {_EDGE} FROM edges WHERE source = (SELECT min(source) FROM sent)",
    "unresolved_edges": f"SELECT {_EDGE} FROM edges WHERE starts_with(target, '__unresolved__::')",
    "unresolved_names": "SELECT split_part(target, ':', 3) AS name, count(*) AS n FROM edges WHERE starts_with(target, '__unresolved__::') GROUP BY 1",
    "unresolved_candidates": "SELECT e.source, e.target, list_sort(list(n.id)) AS candidates FROM sent e JOIN (SELECT id, name FROM nodes WHERE kind <> 'module') n ON n.name = split_part(e.target, ':', 3) GROUP BY e.source, e.target",
    "list_files": "SELECT file FROM hashes",
    "name_cardinality": "SELECT name, count(*) AS n, CASE WHEN count(*) = 1 THEN 'one' ELSE 'many' END AS verdict FROM nodes GROUP BY name",
    "node_id": "SELECT id, file || '::' || name || ':' || start_line AS made FROM nodes WHERE kind <> 'endpoint'",
    "neighbors_out": f"SELECT {_ROW} FROM nb WHERE dir = 'out'",
    "neighbors_in": f"SELECT {_ROW} FROM nb WHERE dir = 'in'",
    "neighbors_both": f"SELECT {_ROW} FROM nb",
    "neighbors_kind": f"SELECT {_ROW} FROM nb WHERE edge_kind = 'routes_to'",
    "neighborhood_sections": "SELECT center, section, dir, id, source, target, edge_kind, provenance_source FROM sec",
    "neighborhood_topk": "SELECT center, section, rn, id, source, target, provenance_source, confidence FROM top WHERE rn <= 10",
    "neighborhood_omitted": "SELECT center, section, greatest(max(n) - 10, 0) AS omitted FROM top GROUP BY center, section",
    "neighborhood_depth2": ", st AS (SELECT DISTINCT source AS here, target AS nxt FROM edges JOIN nodes ON id = target WHERE edges.kind = 'calls'), bfs AS (SELECT id, 0 AS d FROM nodes WHERE name = 'red bolt' UNION SELECT nxt, d + 1 FROM bfs JOIN st ON here = id WHERE d < 2) SELECT id, min(d) AS depth FROM bfs GROUP BY id HAVING min(d) > 0",
    "implementers_listing": "SELECT itf.id AS center, e.source AS id, e.provenance_source, e.confidence FROM itf JOIN edges e ON e.target = itf.id AND e.kind = 'implements' JOIN nodes n ON n.id = e.source",
    "edge_dedup_first": f"SELECT {_EDGE} FROM sent",
    "edge_dedup_last": f"SELECT {_EDGE} FROM calls",
    "upsert_nodes": "SELECT id, kind, name, file, start_line, end_line, 'new' AS content_hash FROM nodes WHERE kind = 'class' UNION ALL SELECT * FROM nodes WHERE kind <> 'class'",
    "delete_edge": f"SELECT {_EDGE} FROM edges WHERE NOT (kind = 'calls' AND provenance_source = 'lsp')",
    "delete_file_edges": f", gone AS (SELECT id FROM nodes WHERE file = (SELECT min(file) FROM fn)) SELECT {_EDGE} FROM edges WHERE provenance_source = 'agent' OR (source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone))",
    "delete_file_nodes": "SELECT * FROM nodes WHERE file <> (SELECT min(file) FROM fn)",
    "agent_upsert": f", w AS (SELECT cl.id AS source, itf.id AS target, 'extends' AS kind, 'agent' AS provenance_source, CAST(0.7 AS DOUBLE) AS confidence, 'seen' AS evidence, h.hash AS content_hash, CAST(1 AS BIGINT) AS created_at FROM cl JOIN itf ON n_nationkey = s_nationkey JOIN hashes h ON h.file = cl.file) SELECT {_EDGE} FROM edges UNION ALL SELECT {_EDGE} FROM w",
    "agent_stale": f"SELECT {', '.join('e.' + c for c in _EDGE.split(', '))}, coalesce(h.hash <> e.content_hash, true) AS stale FROM edges e LEFT JOIN nodes n ON n.id = e.source LEFT JOIN (SELECT file, CASE WHEN file = (SELECT min(file) FROM fn) THEN 'x' ELSE hash END AS hash FROM hashes) h ON h.file = n.file WHERE e.provenance_source = 'agent'",
    "file_hash": "SELECT file, sha256(content) AS hash FROM files",
    "line_count": f"SELECT file, CAST(len({_SPLIT}) AS INTEGER) AS lines FROM files",
    "anchors": f"SELECT n.id, n.file || ':' || start_line || ':' || coalesce(substr(sha256({_TRIM.format(x='(' + _LINE + ')')}), 1, 4), '?') AS anchor, ({_LINE}) IS NULL OR coalesce(h <> content_hash, true) AS stale FROM dnodes n LEFT JOIN (SELECT file, {_SPLIT} AS ls, sha256(content) AS h FROM files) f ON f.file = n.file",
    "anchor_missing": "SELECT n.id, n.file || ':' || start_line || ':?' AS anchor FROM dnodes n WHERE n.file NOT IN (SELECT file FROM files)",
    "index_plan": "SELECT f.file, sha256(content) AS hash, CASE WHEN s.hash IS NULL THEN 'new' WHEN s.hash = sha256(content) THEN 'unchanged' ELSE 'changed' END AS action FROM files f LEFT JOIN stored s ON s.file = f.file UNION ALL SELECT file, NULL, 'removed' FROM stored WHERE file NOT IN (SELECT file FROM files)",
    "index_removed": "SELECT file FROM stored WHERE file NOT IN (SELECT file FROM files)",
    "index_counters": "SELECT count(*) FILTER (WHERE s.hash IS NULL OR s.hash <> sha256(content)) AS indexed, count(*) FILTER (WHERE s.hash = sha256(content)) AS skipped, (SELECT count(*) FROM stored WHERE file NOT IN (SELECT file FROM files)) AS removed, CAST(0 AS BIGINT) AS errors FROM files f LEFT JOIN stored s ON s.file = f.file",
    "symbol_column": f"SELECT file, CAST(greatest(instr({_SPLIT}[1], 'the'), 1) AS INTEGER) AS col FROM files",
    "parse_evidence": "SELECT source, target, split_part(evidence, ':', 1) AS name, CAST(split_part(evidence, ':', 2) AS INTEGER) AS line, CAST(split_part(evidence, ':', 3) AS INTEGER) AS col FROM sent",
    "resolve_calls": "SELECT s.source, n.id AS target, l.def_file || ':' || l.def_line || ':1' AS evidence, s.target AS old_target FROM sent s JOIN lookups l ON l.file = split_part(s.source, '::', 1) AND l.line = CAST(split_part(s.evidence, ':', 2) AS INTEGER) AND l.col = CAST(split_part(s.evidence, ':', 3) AS INTEGER) JOIN nodes n ON n.file = l.def_file AND n.start_line = l.def_line AND n.name = split_part(s.evidence, ':', 1)",
    "confirm_calls": "SELECT s.source, s.target, n.start_line AS def_line FROM calls s JOIN nodes n ON n.id = s.target WHERE provenance_source = 'tree-sitter'",
    "enclosing_fn": "SELECT p.file, p.line, arg_min(f.id, (f.end_line - f.start_line, f.start_line, f.id)) AS function_id FROM (SELECT DISTINCT file, start_line AS line FROM fn) p JOIN fn f ON f.file = p.file AND f.start_line <= p.line AND f.end_line >= p.line GROUP BY p.file, p.line",
    "missing_callers": ", m AS (SELECT symbol_id, ref_file, ref_line, arg_min(n.id, (n.start_line, n.id)) AS source FROM refs JOIN (SELECT * FROM nodes WHERE kind <> 'module') n ON n.file = ref_file AND n.start_line <= ref_line AND (n.end_line IS NULL OR n.end_line >= ref_line) GROUP BY 1, 2, 3) SELECT source, symbol_id AS target, min(ref_file || ':' || ref_line || ':1') AS evidence FROM m WHERE source <> symbol_id AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.source = m.source AND c.target = m.symbol_id) GROUP BY source, symbol_id",
    "implementers": ", a AS (SELECT itf.id AS symbol_id, cl.file AS def_file, cl.start_line + 1 AS def_line FROM cl JOIN itf ON n_nationkey = (s_nationkey + 1) % 25) SELECT source, symbol_id AS target, min(ev) AS evidence FROM (SELECT symbol_id, arg_min(c.id, (c.start_line, c.id)) AS source, def_file || ':' || def_line || ':1' AS ev FROM a JOIN cl c ON c.file = def_file AND c.start_line <= def_line GROUP BY symbol_id, def_file, def_line) WHERE NOT EXISTS (SELECT 1 FROM impl i WHERE i.source = source AND i.target = symbol_id AND false) GROUP BY source, symbol_id",
    "implementers_regex": "SELECT 'supplier/' || s_nationkey || '.ts::S' || s_suppkey || ':' || s_suppkey AS source, itf.id AS target, 'supplier/' || s_nationkey || '.ts:' || s_suppkey || ':1' AS evidence FROM supplier JOIN itf ON n_nationkey = s_nationkey WHERE s_suppkey % 5 <> 0",
    "resolver_pending": "SELECT id FROM fn WHERE p_partkey % 3 <> 0",
    "trace_static": ", st AS (SELECT DISTINCT source, target FROM edges JOIN nodes ON id = target WHERE edges.kind = 'calls'), p AS (SELECT [id] AS path FROM nodes WHERE id = (SELECT min(id) FROM fn) UNION ALL SELECT list_append(path, target) FROM p JOIN st ON source = path[-1] WHERE len(path) < 3 AND NOT list_contains(path, target)) SELECT array_to_string(path, ' > ') AS path, CAST(len(path) - 1 AS INTEGER) AS depth FROM p",
    "pattern_2hop": ", a AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'imports'), b AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'routes_to') SELECT a.source AS a, a.target AS b, b.target AS c FROM a JOIN b ON a.target = b.source JOIN nodes x ON x.id = a.source JOIN nodes y ON y.id = a.target JOIN nodes z ON z.id = b.target",
    "co_change": ', c AS (SELECT DISTINCT o_custkey AS commit, o_orderpriority AS symbol FROM orders), n AS (SELECT symbol, count(*) AS n FROM c GROUP BY symbol), j AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS "both" FROM c x JOIN c y ON x.commit = y.commit AND x.symbol < y.symbol GROUP BY 1, 2) SELECT a, b, "both", na.n + nb.n - "both" AS either FROM j JOIN n na ON na.symbol = a JOIN n nb ON nb.symbol = b WHERE "both" > 0.6 * (na.n + nb.n - "both")',
    "caller_flow": ", rk AS (SELECT *, CAST(split_part(symbol_id, ':', -1) AS INTEGER) AS k FROM refs), m AS (SELECT symbol_id, ref_file, ref_line, arg_min(n.id, (n.start_line, n.id)) AS source FROM (SELECT * FROM rk WHERE k % 3 <> 0 AND k % 5 <> 0) r JOIN (SELECT * FROM nodes WHERE kind <> 'module') n ON n.file = ref_file AND n.start_line <= ref_line AND (n.end_line IS NULL OR n.end_line >= ref_line) GROUP BY 1, 2, 3) SELECT source, symbol_id AS target, 'calls' AS kind, min(ref_file || ':' || ref_line || ':1') AS evidence FROM m WHERE source <> symbol_id AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.source = m.source AND c.target = m.symbol_id) GROUP BY source, symbol_id UNION ALL SELECT DISTINCT '__meta__::resolver::callers::' || symbol_id, symbol_id, 'imports', 'resolved:callers' FROM rk WHERE k % 3 <> 0 AND k % 5 <> 0",
    "co_change_parts": ', c AS (SELECT DISTINCT l_orderkey AS commit, l_partkey AS symbol FROM lineitem), n AS (SELECT symbol, count(*) AS n FROM c GROUP BY symbol), j AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS "both" FROM c x JOIN c y ON x.commit = y.commit AND x.symbol < y.symbol GROUP BY 1, 2) SELECT a, b, "both", na.n + nb.n - "both" AS either FROM j JOIN n na ON na.symbol = a JOIN n nb ON nb.symbol = b WHERE "both" > 0.03 * (na.n + nb.n - "both")',
    "co_executes": ", h AS (SELECT DISTINCT e.event_type AS test, f.id FROM (SELECT DISTINCT event_type, 'part/Brand#' || (user_id % 25 + 1) || '.ts' AS file, CAST(user_id AS INTEGER) AS line FROM events) e JOIN fn f ON f.file = e.file AND f.start_line <= e.line AND f.end_line >= e.line) SELECT x.id AS a, y.id AS b, count(DISTINCT x.test) AS tests FROM h x JOIN h y ON x.test = y.test AND x.id < y.id GROUP BY x.id, y.id",
    "graph_stats": "SELECT 'node' AS what, kind, CAST(NULL AS VARCHAR) AS provenance_source, count(*) AS n FROM nodes GROUP BY CUBE (kind) UNION ALL SELECT 'edge', kind, provenance_source, count(*) FROM edges GROUP BY CUBE (kind, provenance_source)",
    "rule_routes": """, m AS (
  SELECT a.file, CAST(e.event_id + 1 AS INTEGER) AS line, 'endpoint:' || upper(e.event_type) || ':/u/' || (e.user_id % 10) AS target,
    unnest(CASE WHEN e.event_id % 2 = 0 THEN [{'s': 0, 'n': a.name}, {'s': 1, 'n': b.name}] ELSE [{'s': 0, 'n': a.name}] END) AS h
  FROM events e JOIN fn a ON a.p_partkey - 1 = e.event_id % (SELECT count(*) FROM part) JOIN fn b ON b.p_partkey - 1 = (e.event_id * 7 + 3) % (SELECT count(*) FROM part)
), nm AS (SELECT file, name, arg_min(id, (start_line, id)) AS id FROM nodes GROUP BY file, name
), x AS (SELECT nm.id AS source, m.target, 'express-route@' || m.file || ':' || line || ':1' AS evidence, m.file, line, h.s AS s FROM m JOIN nm ON nm.file = m.file AND nm.name = m.h.n)
SELECT source, target, arg_max(evidence, (file, line, s)) AS evidence FROM x GROUP BY source, target""",
    "rule_endpoints": """, m AS (
  SELECT a.file, CAST(e.event_id + 1 AS INTEGER) AS line, 'endpoint:' || upper(e.event_type) || ':/u/' || (e.user_id % 10) AS target
  FROM events e JOIN fn a ON a.p_partkey - 1 = e.event_id % (SELECT count(*) FROM part) JOIN fn b ON b.p_partkey - 1 = (e.event_id * 7 + 3) % (SELECT count(*) FROM part)
) SELECT target AS id, arg_max(file, (file, line)) AS file, arg_max(line, (file, line)) AS start_line FROM m GROUP BY target""",
    "rule_renders": """, m AS (SELECT a.file, a.start_line AS line, b.name AS item FROM fn a JOIN fn b ON a.p_partkey = b.p_partkey + 25
), f AS (SELECT m.file, m.line, m.item, arg_min(x.id, (x.end_line - x.start_line, x.start_line, x.id)) AS source FROM m JOIN fn x ON x.file = m.file AND x.start_line <= m.line AND x.end_line >= m.line GROUP BY 1, 2, 3
), nm AS (SELECT file, name, arg_min(id, (start_line, id)) AS id FROM nodes GROUP BY file, name)
SELECT source, nm.id AS target, arg_max('react-render@' || f.file || ':' || line || ':1', (f.file, line)) AS evidence FROM f JOIN nm ON nm.file = f.file AND nm.name = f.item GROUP BY source, nm.id""",
}
BODY["implementers"] = BODY["implementers"].replace("WHERE NOT EXISTS (SELECT 1 FROM impl i WHERE i.source = source AND i.target = symbol_id AND false) ", "")

ORACLES = {k: GRAPH + v for k, v in BODY.items()}

#: What the small texts hold, read off by hand.
ORACLES |= {
    "extract_demo": """SELECT * FROM (VALUES ('src/a.ts::src/a.ts:1', 'module', NULL), ('src/a.ts::a:2', 'function', NULL), ('src/a.ts::src/a.ts:1', 'imports', '__unresolved__::b:0'),
  ('src/a.ts::a:2', 'calls', '__unresolved__::c:0'), ('src/b.tsx::src/b.tsx:1', 'module', NULL), ('src/b.tsx::B:1', 'function', NULL), ('src/b.tsx::A:2', 'function', NULL),
  ('src/b.tsx::K:3', 'class', NULL), ('src/b.tsx::I:4', 'interface', NULL), ('src/c.ts::src/c.ts:1', 'module', NULL), ('src/c.ts::run:1', 'function', NULL),
  ('src/c.ts::run:1', 'calls', '__unresolved__::load:0'), ('src/c.ts::pick:4', 'function', NULL), ('src/c.ts::pick:4', 'calls', '__unresolved__::Sink:0'),
  ('src/broken.ts::src/broken.ts:1', 'module', NULL)) t(id, kind, target)""",
    "rule_scan": """SELECT file, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, names
FROM (VALUES ('src/a.ts', 5, 1, 'APP,HANDLERS,METHOD,PATH'), ('src/c.ts', 5, 1, 'APP,HANDLERS,METHOD,PATH'), ('src/b.tsx', 1, 24, 'ATTRS,COMPONENT')) t(file, line, col, names)""",
    "src_scan": "SELECT file, sha256(content) AS hash, CAST(NULL AS VARCHAR) AS error FROM (VALUES " + ", ".join("('{}', '{}')".format(f, c.replace("'", "''")) for f, c in SNIPPETS) + ") t(file, content)",
}
