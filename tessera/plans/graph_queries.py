"""Registered queries over the code graph, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filedeps as fd
from ..operators import graph as g
from ..operators import traverse as t
from ..shipping import ship
from .bindings import Facts, oracle

#: name → (query over the facts, SQL with facts in braces or None)
REGISTRY: dict[str, tuple[Callable[[Facts], DataFrame], str | None]] = {}


def register(name: str, query: Callable[[Facts], DataFrame], sql: str | None) -> None:
    REGISTRY[name] = (query, sql)


def _bound(f: Callable[[Facts], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(Facts(spark, sf_dir))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _bound(f) for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: oracle(sql) for k, (_, sql) in REGISTRY.items() if sql}


_PAIRS = """deps AS (SELECT s.path AS source_path, d.path AS target_path, count(*) AS refs FROM {edges} e JOIN {nodes} s ON e.source = s.occurrence JOIN {nodes} d ON e.target = d.occurrence
WHERE e.kind <> 'contains' AND (e.confidence IS NULL OR e.confidence >= 0.95) AND s.path <> d.path GROUP BY s.path, d.path)"""


def _deps(x: Facts) -> DataFrame:
    return fd.pairs(x.nodes, x.edges, 0.95)


register("f1_file_pairs", _deps, f"WITH {_PAIRS} SELECT * FROM deps")
register("f2_dependencies", lambda x: fd.dependencies(_deps(x)).select("source_path", F.array_join("targets", ",").alias("targets")), f"WITH {_PAIRS} SELECT source_path, string_agg(target_path, ',' ORDER BY target_path) AS targets FROM deps GROUP BY source_path")
register("f3_dependents", lambda x: fd.dependents(_deps(x)).select("target_path", F.array_join("sources", ",").alias("sources")), f"WITH {_PAIRS} SELECT target_path, string_agg(source_path, ',' ORDER BY source_path) AS sources FROM deps GROUP BY target_path")
register("f4_dependent_counts", lambda x: fd.dependent_counts(_deps(x)), f"WITH {_PAIRS} SELECT target_path, count(*) AS dependents FROM deps GROUP BY target_path")
register("f5_reach_counts", lambda x: fd.reach_counts(_deps(x)), f"WITH {_PAIRS} SELECT source_path, count(*) AS files, sum(refs)::BIGINT AS refs FROM deps GROUP BY source_path")
register(
    "f7_affected_tests",
    lambda x: t.affected_tests(_deps(x), x.requests.join(x.nodes, F.col("root") == F.col("occurrence")).select("query_id", "path"), "/test_", 3),
    f"""WITH RECURSIVE {_PAIRS}, w AS (SELECT query_id, path, 0 AS depth FROM {{requests}} JOIN {{nodes}} ON root = occurrence
UNION SELECT w.query_id, d.source_path, w.depth + 1 FROM w JOIN deps d ON d.target_path = w.path WHERE w.depth < 3 AND w.path NOT LIKE '%/test#_%' ESCAPE '#')
SELECT query_id, path, min(depth) AS depth FROM w WHERE path LIKE '%/test#_%' ESCAPE '#' GROUP BY query_id, path""",
)

register("e1_select", lambda x: g.select_entities(x.nodes, x.requests.selectExpr("query_id", "root AS occurrence", "CAST(NULL AS STRING) AS qualified_name", "CAST(NULL AS STRING) AS name", "CAST(NULL AS STRING) AS path", "CASE WHEN query_id % 2 = 0 THEN 'class' END AS kind").unionByName(x.requests.selectExpr("query_id + 100 AS query_id", "CAST(NULL AS STRING) AS occurrence", "CAST(NULL AS STRING) AS qualified_name", "'red widget' AS name", "CAST(NULL AS STRING) AS path", "'method' AS kind"))).select("query_id", "occurrence", "kind", "name"),
    "SELECT query_id, occurrence, kind, name FROM {requests} JOIN {nodes} ON root = occurrence WHERE query_id % 2 = 1 OR kind = 'class' UNION ALL SELECT query_id + 100, occurrence, kind, name FROM {requests}, {nodes} WHERE name = 'red widget' AND kind = 'method'")
register("e2_name_prefix", lambda x: g.name_prefix(x.nodes, "red", ["class", "method"]).select("occurrence", "name"), "SELECT occurrence, name FROM {nodes} WHERE starts_with(name, 'red') AND kind IN ('class', 'method') ORDER BY name, occurrence LIMIT 20")
register("e3_name_contains", lambda x: g.name_contains(x.nodes, "Bolt", "red").select("occurrence", "name"), "SELECT occurrence, name FROM {nodes} WHERE contains(lower(name), 'bolt') AND NOT starts_with(lower(name), 'red') ORDER BY length(name), name, occurrence LIMIT 30")
register("e4_wildcard", lambda x: g.wildcard(x.nodes, "Brand#1?::*bolt#*", ["class", "method", "function"]).select("occurrence", "kind_rank"), "SELECT occurrence, CASE kind WHEN 'class' THEN 1 WHEN 'method' THEN 2 ELSE 3 END AS kind_rank FROM {nodes} WHERE qualified_name LIKE 'Brand#1_::%bolt#%' AND kind IN ('class', 'method', 'function')")
register("e5_exported", lambda x: g.exported_symbols(x.nodes), "SELECT path, line, occurrence, name, kind FROM {nodes} WHERE is_exported AND path IS NOT NULL")
register("e8_by_language", lambda x: g.inventory_by_language(x.files), "SELECT language, count(*) AS files, sum(size)::BIGINT AS size FROM {files} GROUP BY language")
register("e8_tree", lambda x: g.inventory_tree(x.files, 2), "SELECT directory, count(*) AS files FROM (SELECT 'src' AS directory FROM {files} UNION ALL SELECT regexp_extract(path, '^[^/]*/[^/]*') FROM {files}) q GROUP BY directory")
register("e9_modules", lambda x: g.module_structure(x.files).select("directory", F.array_join("paths", ",").alias("paths")), "SELECT regexp_replace(path, '/[^/]*$', '') AS directory, string_agg(path, ',' ORDER BY path) AS paths FROM {files} GROUP BY 1")

register("a1_stats", lambda x: g.stats(x.nodes, x.edges, x.files, x.unresolved), """SELECT 'node' AS category, kind AS value, count(*) AS n FROM {nodes} GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM {edges} GROUP BY kind
UNION ALL SELECT 'file', language, count(*) FROM {files} GROUP BY language UNION ALL SELECT 'unresolved', 'all', count(*) FROM {unresolved}""")
register("a2_fan_in", lambda x: g.fan(x.edges, x.nodes, "target"), "SELECT target AS occurrence, count(*) AS n FROM {edges} WHERE target IN (SELECT occurrence FROM {nodes}) GROUP BY target")
register("a3_fan_out", lambda x: g.fan(x.edges, x.nodes, "source"), "SELECT source AS occurrence, count(*) AS n FROM {edges} WHERE source IN (SELECT occurrence FROM {nodes}) GROUP BY source")
register("a4_node_metrics", lambda x: g.node_metrics(x.nodes, x.edges), """SELECT n.occurrence, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing, coalesce(calls, 0) AS calls, coalesce(callers, 0) AS callers, coalesce(children, 0) AS children FROM {nodes} n
LEFT JOIN (SELECT target AS o, count(*) AS incoming, count(*) FILTER (kind = 'calls') AS callers FROM {edges} GROUP BY target) i ON i.o = n.occurrence
LEFT JOIN (SELECT source AS o, count(*) AS outgoing, count(*) FILTER (kind = 'calls') AS calls, count(*) FILTER (kind = 'contains') AS children FROM {edges} GROUP BY source) s ON s.o = n.occurrence""")
register("a4_containment_depth", lambda x: t.containment_depth(x.edges, x.nodes), """WITH RECURSIVE up AS (SELECT target AS node, source AS above FROM {edges} WHERE kind = 'contains' UNION SELECT up.node, e.source FROM up JOIN {edges} e ON e.target = up.above AND e.kind = 'contains')
SELECT occurrence, count(DISTINCT above) AS depth FROM {nodes} LEFT JOIN up ON node = occurrence GROUP BY occurrence""")
register("a5_ambiguous_names", lambda x: g.ambiguous_names(x.nodes, x.edges), "SELECT name, count(*) AS nodes FROM {nodes} GROUP BY name HAVING count(*) > 1 AND bool_or(occurrence IN (SELECT target FROM {edges} WHERE kind <> 'contains'))")
register("a6_languages", lambda x: g.languages_with_exports(x.nodes), "SELECT language, coalesce(bool_or(is_exported), false) AS exports FROM {nodes} GROUP BY language")
register("a7_unresolved_names", lambda x: g.unresolved_among(x.unresolved, x.unresolved.select(F.col("name")).unionByName(x.nodes.select("name"))), "SELECT DISTINCT name FROM (SELECT name FROM {unresolved} UNION ALL SELECT name FROM {nodes}) q WHERE name IN (SELECT name FROM {unresolved} UNION ALL SELECT name_tail FROM {unresolved})")
register("a8_top_depended", lambda x: g.top_depended_on(x.edges, 50), "SELECT target, count(DISTINCT source) AS dependents FROM {edges} WHERE kind <> 'contains' AND source <> target GROUP BY target ORDER BY dependents DESC, target LIMIT 50")
register("a9_top_files", lambda x: g.top_calling_files(x.nodes, x.edges, 50), """SELECT s.path, count(*) FILTER (e.kind IN ('calls', 'instantiates')) AS calls, count(DISTINCT d.path) FILTER (d.path <> s.path) AS reaches,
count(*) FILTER (e.kind IN ('calls', 'instantiates')) * (1 + count(DISTINCT d.path) FILTER (d.path <> s.path)) AS score FROM {edges} e JOIN {nodes} s ON e.source = s.occurrence LEFT JOIN {nodes} d ON e.target = d.occurrence WHERE e.kind <> 'contains' AND s.path IS NOT NULL GROUP BY s.path ORDER BY score DESC, path LIMIT 50""")
_MOD = "regexp_extract({}.path, '^src/([^/]*)', 1)"
register("a10_module_links", lambda x: g.module_links(x.edges, x.nodes.select("occurrence", F.regexp_extract("path", "^src/([^/]*)", 1).alias("module")), 0.95, ["calls", "references", "extends", "implements"]), f"""SELECT {_MOD.format('s')} AS source_module, {_MOD.format('d')} AS target_module, e.kind, count(*) FILTER (coalesce(confidence, 1) >= 0.95) AS certain, count(*) FILTER (coalesce(confidence, 1) < 0.95) AS uncertain,
count(*) FILTER (reason IN ('import', 'qualified-name') OR e.kind IN ('extends', 'implements') OR (reason = 'instance-method' AND coalesce(confidence, 1) >= 0.9)) AS declared
FROM {{edges}} e JOIN {{nodes}} s ON e.source = s.occurrence JOIN {{nodes}} d ON e.target = d.occurrence WHERE e.kind IN ('calls', 'references', 'extends', 'implements') AND {_MOD.format('s')} <> {_MOD.format('d')} GROUP BY 1, 2, 3""")
register("a13_unresolved_in_files", lambda x: g.unresolved_of_files(x.unresolved, x.nodes), "SELECT n.path, u.line, u.occurrence, u.name, u.kind FROM {unresolved} u JOIN {nodes} n ON u.source = n.occurrence")
register("a14_classify_files", lambda x: g.classify_files(x.nodes, x.edges, x.files), """WITH t AS (SELECT path, bool_and(kind IN ('class', 'interface', 'enum', 'type_alias', 'struct', 'trait', 'protocol')) AS ty FROM {nodes} WHERE kind <> 'file' GROUP BY path),
c AS (SELECT DISTINCT s.path FROM {edges} e JOIN {nodes} s ON e.source = s.occurrence WHERE e.kind IN ('calls', 'instantiates')),
i AS (SELECT DISTINCT d.path FROM {edges} e JOIN {nodes} s ON e.source = s.occurrence JOIN {nodes} d ON e.target = d.occurrence WHERE e.kind <> 'contains' AND s.path <> d.path)
SELECT f.path, f.generated OR regexp_matches(f.path, '(\\.pb\\.go|_generated\\.|\\.min\\.js)$') AS generated, coalesce(ty, false) AND f.path NOT IN (SELECT path FROM c) AND f.path NOT IN (SELECT path FROM i) AS ambient FROM {files} f LEFT JOIN t USING (path)""")
register("a17_queue_depth", lambda x: g.by_status(x.snapshots, "outcome", ["published", "failed", "queued", "unchanged", "running"]), "SELECT s AS outcome, count(id) AS n FROM (SELECT unnest(['published', 'failed', 'queued', 'unchanged', 'running']) AS s) q LEFT JOIN {snapshots} ON outcome = s GROUP BY s")

_STEP = "step AS (SELECT DISTINCT source AS s, target AS t FROM {edges} WHERE kind IN (%s) AND (confidence IS NULL OR confidence >= %s))"
register("g1_neighbors", lambda x: g.neighbors(x.edges, x.nodes.filter("kind <> 'file'").select(F.col("ordinal").alias("query_id"), F.col("occurrence").alias("root")), "outgoing", ["calls", "references"], 0.95), "SELECT ordinal AS query_id, target AS neighbor, e.kind, e.occurrence AS edge, confidence FROM {edges} e JOIN {nodes} n ON e.source = n.occurrence WHERE n.kind <> 'file' AND e.kind IN ('calls', 'references') AND (confidence IS NULL OR confidence >= 0.95)")
register("g4_impact", lambda x: t.impact(x.edges, x.requests.select("query_id", F.col("root").alias("node")), 3, least=0.98).select("query_id", "node", "depth"), "WITH RECURSIVE " + _STEP % ("'calls', 'references', 'extends', 'implements'", "0.98") + """, w AS (SELECT query_id, root AS node, 0 AS depth FROM {requests} UNION SELECT query_id, s, depth + 1 FROM w JOIN step ON t = node WHERE depth < 3)
SELECT query_id, node, min(depth) AS depth FROM w GROUP BY query_id, node HAVING min(depth) > 0""")
register("g5_trace", lambda x: t.trace(x.edges, x.requests, 5).select("query_id", "status", "hops"), "WITH RECURSIVE " + _STEP % ("'calls'", "0") + """, w AS (SELECT query_id, root AS node, 0 AS depth FROM {requests} UNION SELECT query_id, t, depth + 1 FROM w JOIN step ON s = node WHERE depth < 5),
m AS (SELECT query_id, node, min(depth) AS hops FROM w GROUP BY query_id, node) SELECT r.query_id, CASE WHEN hops IS NULL THEN 'no_path' ELSE 'ok' END AS status, hops FROM {requests} r LEFT JOIN m ON m.query_id = r.query_id AND m.node = goal""")
register("g6_traverse_edges", lambda x: t.traverse_edges(x.edges, x.requests.select("query_id", F.col("root").alias("node")), 3, ["extends", "implements"]), "WITH RECURSIVE " + _STEP % ("'extends', 'implements'", "0") + """, w AS (SELECT query_id, root AS node, 0 AS depth FROM {requests} UNION SELECT query_id, t, depth + 1 FROM w JOIN step ON s = node WHERE depth < 2)
SELECT query_id, occurrence AS edge, source, target, kind FROM (SELECT DISTINCT query_id, node FROM w) q JOIN {edges} ON source = node WHERE kind IN ('extends', 'implements')""")
register("g7_call_graph", lambda x: t.call_graph(x.edges, x.requests.select("query_id", F.col("root").alias("node")), 2), "WITH RECURSIVE " + _STEP % ("'calls', 'references', 'imports', 'instantiates', 'navigates'", "0") + """, o AS (SELECT query_id, root AS node, 0 AS depth FROM {requests} UNION SELECT query_id, t, depth + 1 FROM o JOIN step ON s = node WHERE depth < 2),
i AS (SELECT query_id, root AS node, 0 AS depth FROM {requests} UNION SELECT query_id, s, depth + 1 FROM i JOIN step ON t = node WHERE depth < 2) SELECT query_id, node, min(depth) AS depth FROM (SELECT * FROM o UNION ALL SELECT * FROM i) q GROUP BY query_id, node""")
register("g8_usages", lambda x: g.usages(x.edges, x.requests).select("query_id", "neighbor", "kind", "edge", "rank"), """SELECT query_id, source AS neighbor, kind, occurrence AS edge, list_position(['contains', 'calls', 'imports', 'exports', 'extends', 'implements', 'references', 'type_of', 'returns', 'instantiates', 'overrides', 'decorates', 'navigates'], kind) AS rank FROM {requests} JOIN {edges} ON target = root""")
register("g14_subtypes", lambda x: g.subtype_counts(x.edges), "SELECT target, count(*) AS subtypes, count(*) FILTER (NOT ext) AS implementers, count(*) FILTER (NOT ext) >= 8 AS polymorphic FROM (SELECT target, source, bool_or(kind = 'extends') AS ext FROM {edges} WHERE kind IN ('extends', 'implements') GROUP BY target, source) q GROUP BY target")
register("g16_subgraph", lambda x: g.filtered_subgraph(x.nodes, x.edges, F.col("is_exported") & F.col("kind").isin("class", "method", "function")), "SELECT e.occurrence, source, target, e.kind FROM {edges} e JOIN {nodes} s ON source = s.occurrence JOIN {nodes} d ON target = d.occurrence WHERE s.is_exported AND d.is_exported AND s.kind IN ('class', 'method', 'function') AND d.kind IN ('class', 'method', 'function')")
_HASH = """SELECT kind, sha256(string_agg(part, ',' ORDER BY part)) AS digest, sum(n)::BIGINT AS rows FROM (SELECT kind, concat_ws(':', b, n, w0 % 18446744073709551616::HUGEINT, w1 % 18446744073709551616::HUGEINT, w2 % 18446744073709551616::HUGEINT, w3 % 18446744073709551616::HUGEINT) AS part, n FROM
(SELECT kind, h[1:2] AS b, count(*) AS n, sum(('0x' || h[1:16])::UBIGINT) AS w0, sum(('0x' || h[17:32])::UBIGINT) AS w1, sum(('0x' || h[33:48])::UBIGINT) AS w2, sum(('0x' || h[49:64])::UBIGINT) AS w3 FROM
(SELECT kind, sha256(concat('{{"occurrence":"', occurrence, '","source":"', source, '","target":"', target, '"}}')) AS h FROM {edges}) r GROUP BY kind, b) q) p GROUP BY kind"""
register("s4_content_hash", lambda x: g.content_hash(x.edges, ["kind"], ["occurrence", "source", "target"]), _HASH)
register("e7_files", lambda x: g.files_under(x.files, "src/Brand#1"), "SELECT path, language, size, generated, node_count, count(*) OVER () AS total FROM {files} WHERE path = 'src/Brand#1' OR starts_with(path, 'src/Brand#1/')")
register("e7_glob", lambda x: g.files_under(x.files, "*.pb.go", "glob").select("path", "total"), "SELECT path, count(*) OVER () AS total FROM {files} WHERE path LIKE '%.pb.go'")
register("e7_pattern", lambda x: g.files_under(x.files, "src/Brand#1?/*SMALL*", "pattern").select("path", "total"), "SELECT path, count(*) OVER () AS total FROM {files} WHERE path LIKE 'src/Brand#1_/%SMALL%'")
_MODULE = lambda x: x.nodes.select("occurrence", F.regexp_extract("path", "^src/([^/]*)", 1).alias("module"))
register("a11_top_pairs", lambda x: g.top_pairs(x.edges, _MODULE(x), 3, ["calls", "references", "extends"]), f"""SELECT * FROM (SELECT source_module, target_module, source, target, declared, n, row_number() OVER (PARTITION BY source_module, target_module ORDER BY declared DESC, n DESC, lower(source), lower(target), source, target) AS rank FROM (
SELECT {_MOD.format('s')} AS source_module, {_MOD.format('d')} AS target_module, e.source, e.target, count(*) FILTER (reason IN ('import', 'qualified-name') OR e.kind = 'extends' OR (reason = 'instance-method' AND coalesce(confidence, 1) >= 0.9)) AS declared, count(*) AS n FROM {{edges}} e JOIN {{nodes}} s ON e.source = s.occurrence JOIN {{nodes}} d ON e.target = d.occurrence
WHERE e.kind IN ('calls', 'references', 'extends') AND {_MOD.format('s')} <> {_MOD.format('d')} GROUP BY 1, 2, 3, 4) q) r WHERE rank <= 3""")
register("f6_cycles", lambda x: t.strong_components(fd.pairs(x.nodes, x.edges.filter("kind = 'calls'"), 0.98)), """WITH RECURSIVE deps AS (SELECT DISTINCT s.path AS s, d.path AS t FROM {edges} e JOIN {nodes} s ON e.source = s.occurrence JOIN {nodes} d ON e.target = d.occurrence WHERE e.kind = 'calls' AND (e.confidence IS NULL OR e.confidence >= 0.98) AND s.path <> d.path),
r AS (SELECT s, t FROM deps UNION SELECT r.s, deps.t FROM r JOIN deps ON r.t = deps.s), m AS (SELECT a.s AS path, least(a.s, min(a.t)) AS component FROM r a JOIN r b ON a.s = b.t AND a.t = b.s GROUP BY a.s)
SELECT path, component, count(*) OVER (PARTITION BY component) AS files FROM m""")
register("f6_cycle_paths", lambda x: t.cycles(fd.pairs(x.nodes, x.edges.filter("kind = 'calls'"), 0.98)).select("component", "no", F.array_join("cycle", " > ").alias("cycle")), None)

_UP = """step AS (SELECT DISTINCT source AS s, target AS t FROM {edges} WHERE kind IN ('extends', 'implements')),
w AS (SELECT query_id, root AS node, 0 AS depth FROM {requests} UNION SELECT query_id, %s, depth + 1 FROM w JOIN step ON %s = node WHERE depth < 3), m AS (SELECT query_id, node, min(depth) AS depth FROM w GROUP BY query_id, node),
v AS (SELECT m.query_id, m.node, m.depth, u.node AS parent, e.occurrence AS edge, e.kind AS relation, (SELECT min(coalesce(z.confidence, 1)) FROM {edges} z WHERE z.occurrence = e.occurrence) < 1 AS heuristic, row_number() OVER (PARTITION BY m.query_id, m.node ORDER BY e.kind, u.node, e.occurrence) AS r FROM m JOIN m u ON u.query_id = m.query_id AND u.depth = m.depth - 1 JOIN {edges} e ON e.%s = u.node AND e.%s = m.node AND e.kind IN ('extends', 'implements')),
hier AS (SELECT query_id, v.node, depth, parent, edge, relation, heuristic, row_number() OVER (PARTITION BY query_id ORDER BY depth, relation, n.name, n.path, n.line, v.node) AS place FROM v JOIN {nodes} n ON n.occurrence = v.node WHERE r = 1)"""
_FOCUS = lambda x: x.requests.select("query_id", F.col("root").alias("node"))
_KNOWN = lambda x: x.edges.join(x.nodes.select(F.col("occurrence").alias("source")), "source", "left_semi").join(x.nodes.select(F.col("occurrence").alias("target")), "target", "left_semi")
register("g13_type_hierarchy", lambda x: t.type_hierarchy(x.edges, _FOCUS(x), "incoming", 3, x.nodes), "WITH RECURSIVE " + _UP % ("s", "t", "target", "source") + " SELECT * FROM hier")
_OVER = "SELECT query_id, own.target AS member, b.target AS base_member, b.source AS base_type, relation FROM {requests} JOIN {members} own ON own.source = root JOIN {nodes} n ON n.occurrence = own.target AND n.kind IN ('method', 'function') JOIN hier USING (query_id) JOIN {members} b ON b.source = hier.node JOIN {nodes} bn ON bn.occurrence = b.target AND bn.name = n.name"
register("g15_overrides", lambda x: t.derived_overrides(x.edges.filter("kind <> 'contains'").unionByName(x.members), x.nodes, x.requests.select("query_id", F.col("root").alias("node")), 3), "WITH RECURSIVE " + _UP % ("t", "s", "source", "target") + f", c AS ({_OVER}), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, member ORDER BY place, line, base_member) AS no FROM ({_OVER.replace('relation FROM', 'relation, place, bn.line FROM')}) z) SELECT query_id, member, base_member, base_type, relation FROM k WHERE no = 1 AND member <> base_member")
