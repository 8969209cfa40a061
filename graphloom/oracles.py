"""DuckDB SQL of the registered queries. Queries on the graph get its three views in front."""

from __future__ import annotations

from graphloom.functions.expressions import BUILTINS
from graphloom.operators import export, metrics
from graphloom.schema import CONTAINER_KINDS, DEFINITION_KINDS, EDGE_KINDS, MODULE_KINDS, NODE_KINDS
from graphloom.sources.generated import EXPECTED
from graphloom.sources.star import CTES


def listed(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def cases(column: str, values: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def quoted(values: dict) -> dict:
    return {k: f"'{v}'" for k, v in values.items()}


DEGREES = """deg AS (SELECT id, sum(o) AS fan_out, sum(i) AS fan_in, sum(o * c) AS calls_out, sum(i * c) AS calls_in, sum(o * d) AS depends_out, sum(i * d) AS depends_in, sum(o * k) AS contains_out FROM (
 SELECT source_node_id AS id, 1 AS o, 0 AS i, CAST(kind = 'Calls' AS INT) AS c, CAST(kind = 'DependsOn' AS INT) AS d, CAST(kind = 'Contains' AS INT) AS k FROM g_edges
 UNION ALL SELECT target_node_id, 0, 1, CAST(kind = 'Calls' AS INT), CAST(kind = 'DependsOn' AS INT), CAST(kind = 'Contains' AS INT) FROM g_edges) GROUP BY id)"""
IMPORTANCE = f"""{DEGREES}, base AS (SELECT n.id, name, kind, file_id, start_line, end_line, coalesce(fan_in, 0) AS fi, coalesce(fan_out, 0) AS fo, greatest(end_line - start_line, 0) AS lines FROM g_nodes n LEFT JOIN deg ON deg.id = n.id),
top AS (SELECT greatest(count(*), 1) AS n, greatest(max(fi), 1) AS mi, greatest(max(lines), 1) AS ml FROM base),
imp AS (SELECT id, name, kind, file_id, start_line, end_line, least(greatest(CAST(fi + fo AS DOUBLE) / n * CAST(0.3 AS DOUBLE) + CAST(fi AS DOUBLE) / mi * CAST(0.2 AS DOUBLE) + CAST(lines AS DOUBLE) / ml * CAST(0.15 AS DOUBLE) + CAST(fo AS DOUBLE) / mi * CAST(0.15 AS DOUBLE)
 + CAST({cases("kind", metrics.KIND_WEIGHTS, "0.5")} AS DOUBLE) * CAST(0.1 AS DOUBLE) + CASE WHEN fi + fo > 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 0), 1) AS importance FROM base, top)"""
IMPORTED = """parsed AS (SELECT id, file_id, start_line, regexp_extract(name, chr(39) || '([^' || chr(39) || ']*)' || chr(39), 1) AS module, list_transform(string_split(regexp_extract(name, '\\{([^}]*)\\}', 1), ','), lambda x: trim(x)) AS names FROM g_nodes WHERE kind = 'Import'),
imported AS (SELECT id, file_id, start_line, module, unnest(names) AS name FROM parsed)"""
DEFS = f"defs AS (SELECT name, min(id) AS def FROM g_nodes WHERE kind IN ({listed(DEFINITION_KINDS)}) GROUP BY name)"
BUILTIN = listed(BUILTINS)
CALLS = f"""ucalls AS (SELECT e.source_node_id, t.name AS ref_name, coalesce(s.file_id, 0) AS file_id, coalesce(s.start_line, 0) AS line, 'UnresolvedCall' AS kind, CAST(NULL AS VARCHAR) AS target_name
 FROM g_edges e JOIN g_nodes t ON t.id = e.target_node_id LEFT JOIN g_nodes s ON s.id = e.source_node_id WHERE e.kind = 'Calls' AND t.name NOT IN ({BUILTIN}) AND t.name NOT IN (SELECT name FROM defs))"""
REFS = f"""urefs AS (SELECT e.source_node_id, s.name AS ref_name, s.file_id, s.start_line AS line, 'UnresolvedRef' AS kind, CAST(NULL AS VARCHAR) AS target_name FROM g_edges e JOIN g_nodes s ON s.id = e.source_node_id
 WHERE e.kind = 'References' AND s.name NOT IN ({BUILTIN}) AND s.name NOT IN (SELECT name FROM defs) AND NOT EXISTS (SELECT 1 FROM imported i WHERE i.file_id = s.file_id AND i.name = s.name))"""
DEAD = "dead AS (SELECT id AS source_node_id, name AS ref_name, file_id, start_line AS line, 'DeadImport' AS kind, module AS target_name FROM imported WHERE name NOT IN (SELECT name FROM defs))"


def walk(root: int, depth: int, edges: str = "SELECT source_node_id AS a, target_node_id AS b FROM g_edges") -> str:
    """Least depth of every node within depth steps."""
    return f"""links AS (SELECT DISTINCT a, b FROM ({edges})), r(node, depth) AS (SELECT CAST({root} AS BIGINT), 0 UNION SELECT b, depth + 1 FROM r JOIN links ON a = node WHERE depth < {depth}),
seen AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)"""


BACK = "SELECT target_node_id AS a, source_node_id AS b FROM g_edges"
BOTH = "SELECT source_node_id AS a, target_node_id AS b FROM g_edges UNION ALL SELECT target_node_id, source_node_id FROM g_edges"
AFFECTED = "SELECT node AS node_id, name, kind, depth FROM seen JOIN g_nodes ON id = node WHERE node <> {root}"
CHILD = "kids AS (SELECT DISTINCT target_node_id AS k FROM g_edges WHERE kind = 'Contains' AND source_node_id = 10001)"
CLOSURE = """dep AS (SELECT DISTINCT source_node_id AS a, target_node_id AS b FROM g_edges WHERE kind = 'DependsOn' AND source_node_id <> target_node_id AND source_node_id IN (SELECT id FROM g_nodes WHERE kind = 'File') AND target_node_id IN (SELECT id FROM g_nodes WHERE kind = 'File')),
tc(a, b) AS (SELECT a, b FROM dep UNION SELECT tc.a, dep.b FROM tc JOIN dep ON tc.b = dep.a),
scc AS (SELECT x.a AS node_id, least(x.a, min(x.b)) AS component FROM tc x JOIN tc y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"""
LAYERS = """layers AS (SELECT id AS file_id, layer FROM g_files, (VALUES ('west', '^(europe/[^/]*|america/.*|europe/.*)$'), ('east', '^asia/.*[^/]*\\.[^/]*$'), ('south', '^(africa/.[^/]*|middle east/.*)$')) v(layer, pat) WHERE regexp_matches(relative_path, pat))"""
TERMS = "tok AS (SELECT id, list_filter(string_split_regex(lower(name || ' ' || properties), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS terms FROM g_nodes)"
DAYS = """days AS (SELECT CAST(ts AS DATE) - DATE '2024-01-01' AS id, count(DISTINCT user_id) AS total_files, count(*) AS total_nodes, count(*) FILTER (event_type = 'click') AS total_edges, round(avg(value), 6) AS avg_complexity, max(length(event_type)) AS max_complexity, count(*) FILTER (event_type = 'error') AS circular_deps FROM events GROUP BY CAST(ts AS DATE))"""
BENCH = "cur AS (SELECT 'g' || CAST(id % 5 AS VARCHAR) || '/' || CAST(id AS VARCHAR) AS name, CAST(start_line AS DOUBLE) * 100 AS base, CAST(start_line AS DOUBLE) * 100 * (CAST(0.5 AS DOUBLE) + (id % 13) * CAST(0.1 AS DOUBLE)) AS mean FROM g_nodes WHERE kind = 'Method'), pct AS (SELECT name, (mean - base) / base * 100 AS p FROM cur), reg AS (SELECT name, round(p, 6) AS change_pct, CASE WHEN p > 50 THEN 'Critical' WHEN p > 25 THEN 'Significant' WHEN p > 10 THEN 'Warning' WHEN p < -10 THEN 'Improvement' END AS severity FROM pct)"
STORED = "stored AS (SELECT relative_path, sha256(language) AS hash FROM g_files WHERE length(relative_path) % 7 <> 0)"
LEFT = "gone AS (SELECT id FROM g_nodes WHERE file_id IN (2, 5))"
HISTOGRAM = "SELECT {c}, count(*) AS n FROM {t} GROUP BY {c}"

SHOWN = "CASE WHEN {v} >= 1e9 THEN format('{{:.2f}}s', {v} / 1e9) WHEN {v} >= 1e6 THEN format('{{:.2f}}ms', {v} / 1e6) WHEN {v} >= 1e3 THEN format('{{:.2f}}µs', {v} / 1e3) ELSE format('{{:.2f}}ns', {v}) END"

GRAPH: dict[str, tuple[str, str]] = {
    "graph_counts": ("", "SELECT 'files' AS what, count(*) AS n FROM g_files UNION ALL SELECT 'nodes', count(*) FROM g_nodes UNION ALL SELECT 'edges', count(*) FROM g_edges"),
    "kind_histogram": ("", HISTOGRAM.format(c="kind", t="g_nodes")),
    "language_histogram": ("", HISTOGRAM.format(c="language", t="g_files")),
    "edge_kind_histogram": ("", HISTOGRAM.format(c="kind", t="g_edges")),
    "files_by_path": ("", "SELECT * FROM g_files"),
    "files_of_language": ("", "SELECT * FROM g_files WHERE language = 'python'"),
    "symbols_by_kind": ("", "SELECT id, kind, name, file_id FROM g_nodes WHERE kind = 'Function' ORDER BY name, id LIMIT 50000"),
    "symbols_name_like": ("", "SELECT id, kind, name FROM g_nodes WHERE name ILIKE '%red%r%'"),
    "symbols_by_file": ("", "SELECT id, kind, name FROM g_nodes WHERE file_id = 3"),
    "symbols_by_prefix": ("", "SELECT id, name FROM g_nodes WHERE starts_with(name, 'un') ORDER BY name, id LIMIT 20 OFFSET 5"),
    "symbol_by_id": ("", "SELECT * FROM g_nodes WHERE id = 1000010"),
    "edges_filtered": ("", "SELECT * FROM g_edges WHERE kind = 'Calls' ORDER BY id LIMIT 50000"),
    "edges_of_source": ("", "SELECT * FROM g_edges WHERE source_node_id = 10000"),
    "symbols_with_path": ("", "SELECT n.id, n.name, coalesce(relative_path, '?') AS path FROM g_nodes n LEFT JOIN g_files f ON f.id = n.file_id"),
    "edges_named": ("", "SELECT e.id, coalesce(s.name || ' [' || s.kind || ']', 'id:' || e.source_node_id) AS source_label, coalesce(t.name || ' [' || t.kind || ']', 'id:' || e.target_node_id) AS target_label, e.kind FROM g_edges e LEFT JOIN g_nodes s ON s.id = source_node_id LEFT JOIN g_nodes t ON t.id = target_node_id"),
    "containers_summary": (IMPORTANCE, f"SELECT i.id, kind, name, file_id, coalesce(n, 0) AS child_count, round(importance, 9) AS importance FROM imp i LEFT JOIN (SELECT source_node_id AS id, count(*) AS n FROM g_edges WHERE kind = 'Contains' GROUP BY 1) c ON c.id = i.id WHERE kind IN ({listed(CONTAINER_KINDS)})"),
    "dependency_graph_rows": (IMPORTANCE, "SELECT id, kind, name, file_id, start_line, end_line, round(importance, 9) AS importance FROM imp"),
    "children_of": (CHILD, "SELECT id, name, id = 10001 AS is_parent FROM g_nodes WHERE id = 10001 OR id IN (SELECT k FROM kids)"),
    "children_edges": (CHILD, "SELECT * FROM g_edges WHERE source_node_id IN (SELECT k FROM kids) OR target_node_id IN (SELECT k FROM kids)"),
    "span_covering_symbol": ("", "SELECT p.file_id, p.line, n.id AS node_id, name FROM (SELECT DISTINCT file_id, start_line AS line FROM g_nodes WHERE kind = 'Function') p JOIN g_nodes n ON n.file_id = p.file_id AND line BETWEEN start_line AND end_line"),
    "induced_subgraph": ("own AS (SELECT id FROM g_nodes WHERE file_id IN (SELECT id FROM g_files WHERE repo_root = 'EUROPE'))", "SELECT * FROM g_edges WHERE source_node_id IN (SELECT id FROM own) AND target_node_id IN (SELECT id FROM own)"),
    "merge_visible": ("", "SELECT * FROM g_edges WHERE kind IN ('Contains', 'DependsOn', 'Calls')"),
    "one_hop_neighbours": ("", "SELECT target_node_id AS id FROM g_edges WHERE source_node_id = 5 UNION SELECT source_node_id FROM g_edges WHERE target_node_id = 5"),
    "lod_filter": (IMPORTANCE, "SELECT id FROM imp WHERE importance >= CAST(0.3 AS DOUBLE)"),
    "function_metrics": (DEGREES, "SELECT n.id, name, CAST(greatest(end_line - start_line, 0) + 1 AS BIGINT) AS line_count, CAST(greatest(1, coalesce(contains_out, 0) + 1) AS BIGINT) AS cyclomatic, CAST(greatest(1, coalesce(contains_out, 0) + (greatest(end_line - start_line, 0) + 1) // 10) AS BIGINT) AS cognitive, CAST(coalesce(json_array_length(properties, '$.parameters'), 0) AS BIGINT) AS parameter_count, CAST(coalesce(calls_out, 0) AS BIGINT) AS fan_out, CAST(coalesce(calls_in, 0) AS BIGINT) AS fan_in FROM g_nodes n LEFT JOIN deg ON deg.id = n.id WHERE kind IN ('Function', 'Method')"),
    "complexity_bands": (DEGREES, "SELECT CASE WHEN c > 10 THEN 'high' WHEN c > 5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM (SELECT greatest(1, coalesce(contains_out, 0) + 1) AS c FROM g_nodes n LEFT JOIN deg ON deg.id = n.id WHERE kind IN ('Function', 'Method')) GROUP BY 1"),
    "module_metrics": (DEGREES, f"SELECT n.id, n.name, CAST(coalesce(calls_in, 0) AS BIGINT) AS fan_in, CAST(coalesce(calls_out, 0) AS BIGINT) AS fan_out, CAST(coalesce(depends_in, 0) AS BIGINT) AS afferent, CAST(coalesce(depends_out, 0) AS BIGINT) AS efferent, round(CASE WHEN coalesce(depends_in + depends_out, 0) > 0 THEN CAST(depends_out AS DOUBLE) / (depends_in + depends_out) ELSE 0 END, 9) AS instability, coalesce(num_methods, 0) AS num_methods, coalesce(num_fields, 0) AS num_fields FROM g_nodes n LEFT JOIN deg ON deg.id = n.id LEFT JOIN (SELECT source_node_id, count(*) FILTER (t.kind = 'Method') AS num_methods, count(*) FILTER (t.kind = 'Field') AS num_fields FROM g_edges e JOIN g_nodes t ON t.id = target_node_id WHERE e.kind = 'Contains' GROUP BY 1) m ON m.source_node_id = n.id WHERE n.kind IN ({listed(MODULE_KINDS)})"),
    "aggregate_metrics": (DEGREES, f"SELECT count(*) AS total_nodes, (SELECT count(*) FROM g_edges) AS total_edges, count(*) FILTER (kind = 'File') AS total_files, round(coalesce(avg(c) FILTER (f), 0), 9) AS avg_complexity, CAST(coalesce(max(c) FILTER (f), 0) AS BIGINT) AS max_complexity, count(*) FILTER (f) AS function_count, count(*) FILTER (kind IN ({listed(MODULE_KINDS)})) AS module_count FROM (SELECT kind, kind IN ('Function', 'Method') AS f, coalesce(contains_out, 0) + 1 AS c FROM g_nodes n LEFT JOIN deg ON deg.id = n.id)"),
    "degrees": (DEGREES, "SELECT id, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("fan_out", "fan_in", "calls_out", "calls_in", "depends_out", "depends_in", "contains_out")) + " FROM deg"),
    "importance": (IMPORTANCE, "SELECT id, name, kind, round(importance, 9) AS importance FROM imp"),
    "importance_topk": (IMPORTANCE, "SELECT id, name, kind, round(importance, 9) AS importance FROM imp ORDER BY round(importance, 9) DESC, id LIMIT 20"),
    "workspace_rollup": ("", "SELECT repo_root, count(*) AS files, CAST(sum(coalesce(n, 0)) AS BIGINT) AS nodes, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages FROM g_files f LEFT JOIN (SELECT file_id, count(*) AS n FROM g_nodes GROUP BY 1) c ON c.file_id = f.id GROUP BY ROLLUP (repo_root)"),
    "file_scc": (CLOSURE, "SELECT * FROM scc"),
    "scc_pair_count": (CLOSURE, "SELECT count(*) - count(DISTINCT component) AS n FROM scc"),
    "impact_forward": (walk(10000, 10), AFFECTED.format(root=10000)),
    "impact_reverse": (walk(1000010, 10, BACK), AFFECTED.format(root=1000010)),
    "impact_depth_limited": (walk(10000, 3), AFFECTED.format(root=10000)),
    "impact_summary": (walk(10000, 3), "SELECT CAST(10000 AS BIGINT) AS root, (SELECT name FROM g_nodes WHERE id = 10000) AS root_name, count(*) AS total_affected, CAST(max(depth) AS INT) AS max_depth, (SELECT count(*) FROM g_edges JOIN seen ON source_node_id = node WHERE depth < 3) > (SELECT count(*) FROM seen) - 1 AS cycle_detected FROM seen JOIN g_nodes ON id = node WHERE node <> 10000"),
    "affected_files": (walk(10000, 3), "SELECT DISTINCT file_id FROM seen JOIN g_nodes ON id = node WHERE node <> 10000"),
    "subtree_nodes": (walk(10000, 2, BOTH), "SELECT id, name, depth FROM seen JOIN g_nodes ON id = node"),
    "subtree_edges": (walk(10000, 2, BOTH), "SELECT DISTINCT source_node_id, target_node_id, kind FROM g_edges WHERE source_node_id IN (SELECT node FROM seen WHERE depth < 2) OR target_node_id IN (SELECT node FROM seen WHERE depth < 2)"),
    "shortest_path_len": (walk(10000, 30), "SELECT max(depth) AS length FROM seen WHERE node = 1000050"),
    "parse_imports": (IMPORTED, "SELECT id, 'Named' AS kind, module, array_to_string(names, '|') AS names FROM parsed"),
    "resolved_refs": (f"{IMPORTED}, {DEFS}", f"SELECT * FROM (SELECT e.source_node_id, e.target_node_id, s.name, coalesce(def, e.target_node_id) AS def_node_id, CASE WHEN def IS NOT NULL THEN 'Local' WHEN EXISTS (SELECT 1 FROM imported i WHERE i.file_id = s.file_id AND i.name = s.name) THEN 'Module' WHEN s.name IN ({BUILTIN}) THEN 'Builtin' END AS kind FROM g_edges e JOIN g_nodes s ON s.id = e.source_node_id LEFT JOIN defs ON defs.name = s.name WHERE e.kind = 'References') WHERE kind IS NOT NULL"),
    "unresolved_refs": (f"{IMPORTED}, {DEFS}, {REFS}", "SELECT * FROM urefs"),
    "unresolved_calls": (f"{DEFS}, {CALLS}", "SELECT * FROM ucalls"),
    "dead_imports": (f"{IMPORTED}, {DEFS}, {DEAD}", "SELECT * FROM dead"),
    "broken_refs_by_kind": (f"{IMPORTED}, {DEFS}, {REFS}, {CALLS}, {DEAD}", 'SELECT 1 AS "pass", kind, count(*) AS n FROM urefs GROUP BY 2 UNION ALL SELECT 2, kind, count(*) FROM ucalls GROUP BY 2 UNION ALL SELECT 3, kind, count(*) FROM dead GROUP BY 2'),
    "arch_file_layers": (LAYERS, "SELECT * FROM layers"),
    "arch_violations": (LAYERS, """SELECT rule_name, arg_min(sl, id) AS source_layer, arg_min(tl, id) AS target_layer, sf AS source_file, tf AS target_file, arg_min(kind, id) AS edge_kind FROM (SELECT e.id, e.kind, s.file_id AS sf, t.file_id AS tf, a.layer AS sl, b.layer AS tl, CASE a.layer WHEN 'west' THEN 'europe first' WHEN 'east' THEN 'asia' ELSE 'rest' END AS rule_name
 FROM g_edges e JOIN g_nodes s ON s.id = source_node_id JOIN g_nodes t ON t.id = target_node_id JOIN layers a ON a.file_id = s.file_id JOIN layers b ON b.file_id = t.file_id WHERE a.layer <> b.layer AND NOT (a.layer = 'west' AND b.layer = 'south') AND NOT (a.layer = 'south' AND b.layer = 'west')) GROUP BY rule_name, sf, tf"""),
    "pattern_findings": ("", "SELECT 'Warning' AS severity, 'Suspicious name: ' || name AS message, start_line AS line, name AS symbol, 'undefined' AS rule FROM g_nodes WHERE contains(name, 'undef_') OR contains(name, 'println') UNION ALL SELECT 'Info', 'Green name: ' || name, start_line, name, 'green' FROM g_nodes WHERE contains(name, 'green')"),
    "plugin_summary": ("one AS (SELECT (SELECT count(*) FROM g_files) AS f, (SELECT count(*) FROM g_nodes) AS n, (SELECT count(*) FROM g_edges) AS e, (SELECT count(*) FILTER (kind = 'Method') / count(*) FILTER (kind IN ('Function', 'Method')) FROM g_nodes) AS r)", "SELECT 'Info' AS severity, format('Repository summary: {} files, {} symbols, {} edges (avg {:.1f} symbols/file)', f, n, e, n / f) AS message, 'summary' AS rule FROM one UNION ALL SELECT 'Warning', format('High symbol count ({}) — consider splitting large modules', n), 'large_codebase' FROM one WHERE n > 2000 UNION ALL SELECT 'Info', format('High method ratio ({:.0f}%) — strongly object-oriented codebase', r * 100), 'oop_ratio' FROM one WHERE r > 0.2"),
    "plugin_run_all": ("", "SELECT 'metrics-summary' AS plugin, 'summary' AS rule, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'metrics-summary', 'large_codebase', 1 FROM g_nodes HAVING count(*) > 50000 UNION ALL SELECT 'names', 'undefined', count(*) FROM g_nodes WHERE contains(name, 'undef_') OR contains(name, 'println') HAVING count(*) > 0 UNION ALL SELECT 'names', 'green', count(*) FROM g_nodes WHERE contains(name, 'green') HAVING count(*) > 0"),
    "plugin_high_impact": ("t AS (SELECT id, list_filter(string_split_regex(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS terms FROM g_nodes)", "SELECT relative_path, count(*) AS n FROM t, (VALUES ('src/supplier.ts', ['supplier']), ('lib/red_rod.py', ['red', 'rod']), ('x/widget.test.js', ['widget', 'test']), ('none/nowhere.go', ['nowhere'])) v(relative_path, wanted) WHERE list_has_all(terms, wanted) GROUP BY 1 HAVING count(*) > 10"),
    "broken_refs_of_kind": (f"{IMPORTED}, {DEFS}, {DEAD}", "SELECT source_node_id, ref_name, file_id, line, target_name FROM dead"),
    "known_kinds": ("", f"SELECT 'node' AS what, CASE WHEN id % 3 = 0 OR kind NOT IN ({listed(NODE_KINDS)}) THEN 'Anonymous' ELSE kind END AS kind, count(*) AS n FROM g_nodes GROUP BY 2 UNION ALL SELECT 'edge', CASE WHEN id % 4 = 1 OR kind NOT IN ({listed(EDGE_KINDS)}) THEN 'References' ELSE kind END, count(*) FROM g_edges GROUP BY 2"),
    "files_matching": ("", "SELECT id, relative_path FROM g_files WHERE contains(lower(relative_path), 'nation_1')"),
    "symbol_tree": ("", "SELECT n.id, CAST(e.source_node_id AS VARCHAR) AS parent_module, n.kind AS parent_class FROM g_nodes n LEFT JOIN g_edges e ON e.kind = 'Contains' AND e.target_node_id = n.id"),
    "graph_snapshot": (f"{DEGREES}, {CLOSURE}, one AS (SELECT (SELECT count(*) FROM g_nodes) AS total_nodes, (SELECT count(*) FROM g_edges) AS total_edges, (SELECT count(*) FROM g_nodes WHERE kind = 'File') AS total_files, (SELECT round(coalesce(avg(greatest(1, coalesce(contains_out, 0) + 1)), 0), 9) FROM g_nodes n LEFT JOIN deg ON deg.id = n.id WHERE kind IN ('Function', 'Method')) AS avg_complexity, (SELECT coalesce(max(greatest(1, coalesce(contains_out, 0) + 1)), 0) FROM g_nodes n LEFT JOIN deg ON deg.id = n.id WHERE kind IN ('Function', 'Method')) AS max_complexity, (SELECT count(*) - count(DISTINCT component) FROM scc) AS circular_deps)", " UNION ALL ".join(f"SELECT CAST(7 AS BIGINT) AS snapshot_id, '{m}' AS metric_name, CAST({m} AS DOUBLE) AS metric_value FROM one" for m in ("total_nodes", "total_edges", "total_files", "avg_complexity", "max_complexity", "circular_deps"))),
    "watched_and_found": ("", "SELECT id, relative_path FROM g_files WHERE id % 2 = 0"),
    "unique_files": ("", "SELECT max(id) AS id, language AS relative_path, arg_max(repo_root, id) AS repo_root FROM g_files GROUP BY language"),
    "export_json_lines": ("", "SELECT 'node' AS what, CAST(id AS VARCHAR) AS id, kind, name, CAST(NULL AS VARCHAR) AS source_node_id, CAST(NULL AS VARCHAR) AS target_node_id FROM g_nodes UNION ALL SELECT 'edge', CAST(id AS VARCHAR), kind, NULL, CAST(source_node_id AS VARCHAR), CAST(target_node_id AS VARCHAR) FROM g_edges"),
    "search_terms": (TERMS, "SELECT id, name FROM tok JOIN g_nodes USING (id) WHERE list_contains(terms, 'supplier') AND list_contains(terms, '000000007') ORDER BY id LIMIT 50"),
    "search_like_fallback": ("", "SELECT id, name FROM g_nodes WHERE name ILIKE '%ed_r%' ORDER BY name, id LIMIT 50000"),
    "search_bm25": (TERMS + ", k AS (SELECT t.id, terms, len(terms) AS len FROM tok t JOIN g_nodes n ON n.id = t.id WHERE kind <> 'Import' AND len(terms) > 0), s AS (SELECT count(*) AS n, avg(len) AS mean FROM k), w AS (SELECT id, len, q, len(list_filter(terms, lambda t: starts_with(t, q))) AS tf FROM k, (VALUES ('supplier'), ('println')) v(q)), d AS (SELECT q, count(*) AS df FROM w WHERE tf > 0 GROUP BY q)",
        "SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / mean))), 6) AS rank FROM w JOIN d ON d.q = w.q, s WHERE tf > 0 GROUP BY id ORDER BY rank DESC, id LIMIT 40"),
    "export_dot_lines": ("", f"""SELECT 0 AS section, CAST(i AS BIGINT) AS id, l AS line FROM (VALUES (0, 'digraph code {{'), (1, '  rankdir=LR;'), (2, '  node [shape=box, style=filled, fontname="monospace"];')) v(i, l) UNION ALL SELECT 3, 0, '}}'
 UNION ALL SELECT 1, id, '  n' || id || ' [label="' || replace(name, '"', '\\"') || '\\n' || kind || '", fillcolor="' || {cases("kind", quoted(export.NODE_COLOURS), "'#90a4ae'")} || '"];' FROM g_nodes
 UNION ALL SELECT 2, id, '  n' || source_node_id || ' -> n' || target_node_id || ' [color="' || {cases("kind", quoted(export.EDGE_COLOURS), "'#757575'")} || '", style=' || {cases("kind", quoted(export.EDGE_STYLES), "'solid'")} || ', label="' || kind || '"];' FROM g_edges"""),
    "export_csv_lines": ("", "SELECT id || ',' || kind || ',' || CASE WHEN regexp_matches(name, '[,\"\\n]') THEN '\"' || replace(name, '\"', '\"\"') || '\"' ELSE name END || ',' || file_id AS line FROM g_nodes"),
    "export_json_counts": ("", "SELECT 'node' AS what, count(*) AS n FROM g_nodes UNION ALL SELECT 'edge', count(*) FROM g_edges"),
    "changed_files": (STORED, "SELECT f.relative_path, h AS hash FROM (SELECT relative_path, CASE WHEN language = 'go' THEN sha256(relative_path) ELSE sha256(language) END AS h FROM g_files) f LEFT JOIN stored s ON s.relative_path = f.relative_path WHERE s.hash IS NULL OR s.hash <> h"),
    "deleted_files": (STORED, "SELECT * FROM stored WHERE relative_path NOT IN (SELECT relative_path FROM g_files WHERE repo_root <> 'ASIA')"),
    "cascade_after_delete": (LEFT, "SELECT 'files' AS what, count(*) AS n FROM g_files WHERE id NOT IN (2, 5) UNION ALL SELECT 'nodes', count(*) FROM g_nodes WHERE file_id NOT IN (2, 5) UNION ALL SELECT 'edges', count(*) FROM g_edges WHERE source_node_id NOT IN (SELECT id FROM gone) AND target_node_id NOT IN (SELECT id FROM gone)"),
    "incremental_vs_full": ("", "SELECT 'nodes' AS what, true AS in_full, true AS in_incremental, count(*) AS n FROM g_nodes UNION ALL SELECT 'edges', true, true, count(*) FROM g_edges"),
    "regression_classify": (BENCH, "SELECT * FROM reg WHERE severity IS NOT NULL"),
    "regression_counts": (BENCH, "SELECT count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'Significant') AS significant, count(*) FILTER (severity = 'Warning') AS warning, count(*) FILTER (severity = 'Improvement') AS improvement FROM reg"),
    "bench_group_report": (BENCH, "SELECT string_split(name, '/')[1] AS group_name, count(*) AS n, min(base) AS min_ns, max(base) AS max_ns, list_sort(list(base))[count(*) // 2 + 1] AS median_ns FROM cur GROUP BY 1"),
    "bench_report_lines": (BENCH, f"SELECT split_part(name, '/', 1) AS group_name, split_part(name, '/', 2) AS benchmark, {SHOWN.format(v='base')} AS mean, '±' || {SHOWN.format(v='base / 10')} AS deviation, CAST(split_part(name, '/', 2) AS BIGINT) % 7 + 1 AS iterations, CASE WHEN 1e9 / base >= 1e6 THEN format('{{:.1f}}M ops/s', floor(1e9 / base / 1e6 * 10 + 0.5) / 10) WHEN 1e9 / base >= 1e3 THEN format('{{:.1f}}K ops/s', floor(1e9 / base / 1e3 * 10 + 0.5) / 10) ELSE format('{{:.1f}} ops/s', floor(1e9 / base * 10 + 0.5) / 10) END AS throughput FROM cur"),
    "bench_parse_rates": (BENCH, f"SELECT 'parse_throughput/' || language || '/' || id AS name, language, lines, {SHOWN.format(v='base')} AS time, CAST(floor(lines / base * 1e9 + 0.5) AS BIGINT) AS lines_per_second FROM (SELECT base, CAST(split_part(name, '/', 2) AS BIGINT) AS id FROM cur) JOIN (VALUES (0, 'typescript_small', 100), (1, 'typescript_medium', 500), (2, 'typescript_large', 5000), (3, 'python_small', 80), (4, 'python_medium', 400), (5, 'go_medium', 300), (6, 'rust_medium', 350), (7, 'java_large', 200)) v(k, language, lines) ON id % 8 = k"),
    "formatted_durations": ("", "SELECT id, CASE WHEN v >= 1e9 THEN format('{:.2f}s', v / 1e9) WHEN v >= 1e6 THEN format('{:.2f}ms', v / 1e6) WHEN v >= 1e3 THEN format('{:.2f}µs', v / 1e3) ELSE format('{:.2f}ns', v) END AS shown FROM (SELECT id, CAST(pow(10, id % 11) * 2 AS DOUBLE) AS v FROM g_nodes WHERE kind = 'Method')"),
}

TABLES: dict[str, str] = {
    "extracted_symbols": f"WITH {EXPECTED} SELECT file_id, kind, name, start_line, start_col, end_line, end_col FROM symbols",
    "extracted_edges": f"WITH {EXPECTED} SELECT id AS file_id, 'Contains' AS kind, 'Order' || id AS source_name, 'line' || n AS target_name, 1 + 2 * i AS target_line FROM lines UNION ALL SELECT file_id, 'Calls', caller, name, def_line FROM uses",
    "span_covering_place": f"WITH {EXPECTED} SELECT u.file_id, u.line, u.col, s.kind, s.name FROM uses u JOIN symbols s ON s.file_id = u.file_id AND (u.line > s.start_line OR u.line = s.start_line AND u.col >= s.start_col) AND (u.line < s.end_line OR u.line = s.end_line AND u.col <= s.end_col)",
    "store_refresh": f"""WITH {EXPECTED}, s AS (SELECT 'o' || file_id || CASE WHEN file_id % 2 = 1 THEN '.py' ELSE '.ts' END AS path, kind, name, start_line, end_line FROM symbols)
SELECT 'symbol' AS what, * FROM s UNION ALL SELECT 'search', * FROM s WHERE name = 'use1' UNION ALL SELECT 'snapshot', '', '', 'total_nodes', count(*), count(*) FROM s
UNION ALL SELECT 'snapshot', '', '', 'total_edges', 2 * count(*), 2 * count(*) FROM lines UNION ALL SELECT 'snapshot', '', '', x, 1, 1 FROM (VALUES ('avg_complexity'), ('max_complexity')) v(x)""",
    "scope_resolution": f"WITH {EXPECTED} SELECT file_id, name, line, col, def_line FROM uses",
    "snapshot_trend": f"WITH {DAYS} SELECT id AS snapshot_id, CAST(total_nodes AS DOUBLE) AS value FROM days",
    "snapshot_unpivot": f"WITH {DAYS} " + " UNION ALL ".join(f"SELECT id AS snapshot_id, '{m}' AS metric_name, CAST({m} AS DOUBLE) AS metric_value FROM days" for m in ("total_nodes", "total_edges", "total_files", "avg_complexity", "max_complexity", "circular_deps")),
    "latest_snapshot": f"WITH {DAYS} SELECT id, total_nodes FROM days ORDER BY id DESC LIMIT 1",
    "diff_summary": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
m AS (SELECT doc_id, i, CASE WHEN i % 4 = 0 THEN 'diff --git a/x b/f' || length(x) % 5 WHEN length(x) % 3 = 0 THEN '+' || x WHEN length(x) % 3 = 1 THEN '-' || x ELSE x END AS y FROM l),
f AS (SELECT doc_id, y, last_value(CASE WHEN i % 4 = 0 THEN regexp_extract(y, ' b/(.*)$', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS file FROM m)
SELECT doc_id, file, count(*) FILTER (starts_with(y, '+') AND NOT starts_with(y, '+++')) AS additions, count(*) FILTER (starts_with(y, '-') AND NOT starts_with(y, '---')) AS deletions, 'Modified' AS change_type FROM f GROUP BY doc_id, file""",
    "doc_hash_linecount": "SELECT doc_id, sha256(text) AS hash, length(text) - length(replace(text, chr(10), '')) AS lines FROM documents",
    "url_language": "SELECT page_id, CASE lower(regexp_extract(p, '[^/]\\.([^./]+)$', 1)) WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' END AS language FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.PY' WHEN 2 THEN '.unknown' ELSE '' END AS p FROM pages)",
    "conversation_next_edges": "SELECT * FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn, 'Next' AS kind FROM conversations) WHERE next_turn IS NOT NULL",
    "events_debounced_batches": "WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, event_type, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first_ts, count(DISTINCT event_type) AS n_paths, count(*) AS n FROM s GROUP BY user_id, k",
}


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH RECURSIVE {CTES}{', ' if more else ''}{more} {sql}" for name, (more, sql) in GRAPH.items()} | TABLES
