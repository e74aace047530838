"""Registered queries that look at one thing, compose answers, and state an answer's boundaries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import envelope as env
from ..operators import explore as ex
from ..operators import inspect as ins
from ..operators import search as s
from ..operators import traverse as t
from .bindings import Facts
from .graph_queries import register

_RANK = "list_position(['contains', 'calls', 'imports', 'exports', 'extends', 'implements', 'references', 'type_of', 'returns', 'instantiates', 'overrides', 'decorates', 'navigates'], kind)"
_roots = lambda x: x.requests.select("query_id", "root")
_names = lambda x: x.hits.filter("r <= 3").join(x.nodes, "occurrence").select("query_id", "name").distinct()
_NAMES = "names AS (SELECT DISTINCT query_id, name FROM {hits} JOIN {nodes} USING (occurrence) WHERE r <= 3)"

register("e6_file_nodes", lambda x: ins.file_nodes(x.nodes, x.entities.filter("line % 7 = 0").select("path")).select("occurrence", "path"), "SELECT occurrence, path FROM {nodes} WHERE kind = 'file' AND path IN (SELECT path FROM {entities} WHERE line % 7 = 0)")
_SPELLED = """SELECT query_id, CASE query_id % 4 WHEN 0 THEN concat('Brand#', CAST(query_id % 25 + 1 AS STRING), '::crate.red bolt') WHEN 1 THEN concat('SMALL_', CAST(query_id % 10 AS STRING)) WHEN 2 THEN 'small ring/2' ELSE concat('Brand#', CAST(query_id % 25 + 1 AS STRING), '/red bolt') END AS text FROM {requests}"""
register("e10_spelled", lambda x: ins.spelled_variants(x.nodes, x.spark.sql(_SPELLED, requests=x.requests), F.col("path").endswith(".pb.go")), """WITH c AS (SELECT query_id, n.occurrence, n.path, n.line FROM {requests} JOIN {nodes} n ON CASE query_id % 4 WHEN 0 THEN n.name = 'red bolt' AND (contains(qualified_name, concat('Brand#', query_id % 25 + 1)) OR contains(concat('/', n.path, '/'), concat('/Brand#', query_id % 25 + 1, '/')))
WHEN 1 THEN n.kind = 'file' AND regexp_matches(n.path, concat('/SMALL_', query_id % 10, '\\.[^.]*$')) WHEN 2 THEN n.name = 'small ring' ELSE n.name = 'red bolt' AND (contains(qualified_name, concat('Brand#', query_id % 25 + 1)) OR contains(concat('/', n.path, '/'), concat('/Brand#', query_id % 25 + 1, '/'))) END)
SELECT * FROM (SELECT query_id, occurrence, row_number() OVER (PARTITION BY query_id ORDER BY path LIKE '%.pb.go', path, line, occurrence) AS no FROM c) q WHERE no <= 50""")
register("e11_definitions", lambda x: ins.group_definitions(x.hits.join(x.nodes, "occurrence"), x.requests.select("query_id", F.expr("CASE WHEN query_id % 3 = 0 THEN 'SMALL_3.go' WHEN query_id % 3 = 1 THEN concat('src/Brand#', query_id, '/none.go') END").alias("file"))), """WITH g AS (SELECT query_id, path, qualified_name, count(*) AS definitions, min(occurrence) AS occurrence FROM {hits} JOIN {nodes} USING (occurrence) GROUP BY 1, 2, 3),
f AS (SELECT *, query_id % 3 = 0 AND path LIKE '%/SMALL_3.go' AS fits FROM g), a AS (SELECT *, bool_or(fits) OVER (PARTITION BY query_id) AS hit FROM f)
SELECT query_id, path, qualified_name, definitions, occurrence, query_id % 3 < 2 AND NOT hit AS unmatched FROM a WHERE fits OR NOT hit""")
_OPT = "SELECT occurrence, language, path, line, CASE kind WHEN 'interface' THEN concat('options.', replace(name, ' ', '.')) ELSE replace(name, ' ', '.') END AS name FROM {entities}"
register("e12_dotted_options", lambda x: ins.dotted_options(x.spark.sql(_OPT, entities=x.entities), x.entities.filter("ordinal % 40 = 0").select(F.col("ordinal").alias("query_id"), F.expr("CASE ordinal % 80 WHEN 0 THEN replace(name, ' ', '.') ELSE split(name, ' ')[0] END").alias("text")), "python"), f"""WITH o AS (SELECT * FROM ({_OPT}) z WHERE language = 'python'), q AS (SELECT ordinal AS query_id, CASE ordinal % 80 WHEN 0 THEN replace(name, ' ', '.') ELSE split_part(name, ' ', 1) END AS text FROM {{entities}} WHERE ordinal % 40 = 0),
u AS (SELECT query_id, 0 AS tier, name, path, line, occurrence FROM q JOIN o ON name = concat('options.', text) UNION ALL SELECT query_id, 1, name, path, line, occurrence FROM q JOIN o ON name = text
UNION ALL SELECT query_id, 2, name, path, line, occurrence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name, path, line, occurrence) AS r FROM q JOIN o ON starts_with(name, concat(text, '.'))) w WHERE r <= 12)
SELECT * FROM (SELECT query_id, occurrence, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, name, path, line, occurrence) AS no FROM u) z WHERE no <= 10""")
_found = lambda x: x.requests.select("query_id", F.col("root").alias("occurrence")).unionByName(x.requests.filter("query_id % 4 = 0").select("query_id", F.col("goal").alias("occurrence"))).join(x.nodes.select("occurrence"), "occurrence", "left_semi")
register("e13_inspect_entity", lambda x: ins.inspect_entity(x.nodes, x.edges, x.unresolved, _found(x))[0], """WITH f AS (SELECT query_id, root AS occurrence FROM {requests} UNION ALL SELECT query_id, goal FROM {requests} WHERE query_id % 4 = 0), m AS (SELECT query_id, count(*) AS matches, min(occurrence) AS occurrence FROM f WHERE occurrence IN (SELECT occurrence FROM {nodes}) GROUP BY query_id)
SELECT query_id, CASE matches WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status, matches, occurrence, CASE matches WHEN 1 THEN (SELECT count(DISTINCT source) FROM {edges} WHERE target = occurrence_ AND kind = 'calls') ELSE 0 END AS callers,
CASE matches WHEN 1 THEN (SELECT count(DISTINCT target) FROM {edges} WHERE source = occurrence_ AND kind = 'calls') ELSE 0 END AS callees, (SELECT count(*) FROM {unresolved} u WHERE u.source = occurrence_) AS unresolved FROM (SELECT *, occurrence AS occurrence_ FROM m) z""")
_paths = lambda x: x.requests.join(x.nodes, F.col("root") == F.col("occurrence")).select("query_id", "path")
register("e14_inspect_file", lambda x: ins.inspect_file(x.nodes, x.edges, x.files, _paths(x), first=1, size=3)[1], """WITH q AS (SELECT query_id, path FROM {requests} JOIN {nodes} ON root = occurrence), o AS (SELECT query_id, n.occurrence, n.kind, n.name, n.line, CASE WHEN EXISTS (SELECT 1 FROM {edges} e WHERE e.kind = 'contains' AND e.target = n.occurrence AND e.source = concat('file:', n.path)) THEN 1 END AS level,
row_number() OVER (PARTITION BY query_id ORDER BY n.line, n.occurrence) AS no FROM q JOIN {nodes} n USING (path) WHERE n.kind <> 'file') SELECT * FROM o WHERE no > 1 AND no <= 4""")
register("e14_file_facts", lambda x: ins.inspect_file(x.nodes, x.edges, x.files, _paths(x))[0].select("query_id", "path", "size", "entities"), "SELECT query_id, path, size, (SELECT count(*) FROM {nodes} m WHERE m.path = f.path AND kind <> 'file') AS entities FROM {requests} JOIN {nodes} n ON root = occurrence JOIN {files} f USING (path)")

_LEGACY = "SELECT query_id, root, CASE query_id % 2 WHEN 0 THEN 'extends' ELSE 'calls' END AS relation, CASE query_id % 3 WHEN 0 THEN 'outgoing' ELSE 'incoming' END AS direction FROM {requests}"
register("g2_legacy_neighbors", lambda x: ins.legacy_neighbors(x.nodes, x.edges, x.spark.sql(_LEGACY, requests=x.requests), F.col("reason") == "heuristic", 20), f"""WITH q AS ({_LEGACY}), e AS (SELECT source, target, occurrence, kind AS relation FROM {{edges}} UNION ALL SELECT source, target, occurrence, 'extends' FROM {{edges}} WHERE kind = 'type_of' AND reason = 'heuristic'),
h AS (SELECT query_id, root, target AS neighbor, relation, e.occurrence AS edge FROM q JOIN e USING (relation) WHERE direction = 'outgoing' AND source = root UNION ALL SELECT query_id, root, source, relation, e.occurrence FROM q JOIN e USING (relation) WHERE direction = 'incoming' AND target = root)
SELECT * FROM (SELECT query_id, root, neighbor, relation, edge, row_number() OVER (PARTITION BY query_id ORDER BY path, line, neighbor, edge) AS no FROM h JOIN {{nodes}} n ON n.occurrence = neighbor AND n.kind <> 'file') z WHERE no <= 20""")
register("g3_context", lambda x: ins.context_of_names(x.nodes, x.edges, x.hits.filter("r <= 2").join(x.nodes, "occurrence").select((F.col("query_id") * 10 + F.col("r")).alias("query_id"), "name", "kind"), 4), """WITH q AS (SELECT query_id * 10 + r AS query_id, name, kind FROM {hits} JOIN {nodes} USING (occurrence) WHERE r <= 2), h AS (SELECT query_id, occurrence, count(*) OVER (PARTITION BY query_id) AS n FROM q JOIN {nodes} USING (name, kind)),
x AS (SELECT 'outgoing' AS direction, source AS occurrence, target AS node, kind, occurrence AS edge FROM {edges} UNION ALL SELECT 'incoming', target, source, kind, occurrence FROM {edges}),
k AS (SELECT query_id, 'ok' AS status, direction, kind, node, row_number() OVER (PARTITION BY query_id, direction, kind ORDER BY node, edge) AS no FROM h JOIN x USING (occurrence) WHERE n = 1 AND kind IN ('calls', 'references', 'extends', 'implements')
UNION ALL SELECT query_id, 'ambiguous', NULL, NULL, occurrence, row_number() OVER (PARTITION BY query_id ORDER BY occurrence) FROM h WHERE n > 1) SELECT * FROM k WHERE no <= 4""")
_REL = f"""SELECT query_id, definition, other, kind, edge, no FROM (SELECT query_id, n.occurrence AS definition, other, kind, edge, row_number() OVER (PARTITION BY query_id, n.occurrence ORDER BY k, edge) AS no FROM names JOIN {{nodes}} n USING (name) JOIN
(SELECT %s AS definition, %s AS other, e.kind, occurrence AS edge, k, row_number() OVER (PARTITION BY source, target ORDER BY k, occurrence) AS r FROM (SELECT *, {_RANK} AS k FROM {{edges}} WHERE kind IN ('calls', 'imports', 'instantiates', 'navigates', 'references')) e) w ON w.definition = n.occurrence AND r = 1 WHERE n.kind <> 'file') z WHERE no <= 5"""
register("g10_callers", lambda x: ins.related(x.edges, x.nodes, _names(x), "incoming", 5), f"WITH {_NAMES} " + (_REL % ("target", "source")).replace(", kind, edge, row_number", ", w.kind, edge, row_number"))
register("g10_callees", lambda x: ins.related(x.edges, x.nodes, _names(x), "outgoing", 5), f"WITH {_NAMES} " + (_REL % ("source", "target")).replace(", kind, edge, row_number", ", w.kind, edge, row_number"))
_RADIUS = f"""WITH {_NAMES}, d AS (SELECT DISTINCT query_id, n.occurrence AS node FROM names JOIN {{nodes}} n USING (name) WHERE n.kind <> 'file'), b AS (SELECT DISTINCT query_id, source AS node FROM d JOIN {{edges}} ON target = node AND kind <> 'contains'),
r AS (SELECT * FROM b EXCEPT SELECT * FROM d)"""
register("g11_radius_of_names", lambda x: ins.radius_of_names(x.nodes, x.edges, _names(x), 1)[0], _RADIUS + " SELECT query_id, node, 1 AS depth FROM r")
register("g11_links_of_names", lambda x: ins.radius_of_names(x.nodes, x.edges, _names(x), 1)[1].groupBy("query_id", "kind").agg(F.count("*").alias("n")), _RADIUS + ", a AS (SELECT * FROM r UNION SELECT * FROM d) SELECT query_id, kind, count(*) AS n FROM (SELECT DISTINCT a.query_id, source, target, kind FROM {edges} JOIN a ON a.node = source JOIN a z ON z.node = target AND z.query_id = a.query_id WHERE kind <> 'contains') q GROUP BY 1, 2")
_BOX = """WITH RECURSIVE box AS (SELECT source AS s, target AS t FROM {edges} WHERE kind = 'contains'),
i0 AS (SELECT query_id, root AS node FROM {requests} UNION SELECT query_id, t FROM i0 JOIN box ON s = node),
b1 AS (SELECT DISTINCT query_id, source AS node FROM i0 JOIN {edges} ON target = node AND kind <> 'contains'), n1 AS (SELECT * FROM b1 EXCEPT SELECT * FROM i0),
i1 AS (SELECT query_id, node FROM n1 UNION SELECT query_id, t FROM i1 JOIN box ON s = node), s1 AS (SELECT * FROM i1 EXCEPT SELECT * FROM i0),
b2 AS (SELECT DISTINCT query_id, source AS node FROM s1 JOIN {edges} ON target = node AND kind <> 'contains'), n2 AS (SELECT * FROM b2 EXCEPT SELECT * FROM i0 EXCEPT SELECT * FROM s1),
i2 AS (SELECT query_id, node FROM n2 UNION SELECT query_id, t FROM i2 JOIN box ON s = node), s2 AS (SELECT * FROM i2 EXCEPT SELECT * FROM i0 EXCEPT SELECT * FROM s1),
radius AS (SELECT query_id, node, 1 AS depth FROM s1 UNION ALL SELECT query_id, node, 2 FROM s2)"""
_files_as_roots = lambda x: _paths(x).select("query_id", F.concat(F.lit("file:"), F.col("path")).alias("node"))
_radius = lambda x: t.impact_radius(x.nodes, x.edges, _files_as_roots(x), 2)
_BOXED = _BOX.replace("SELECT query_id, root AS node FROM {requests}", "SELECT query_id, concat('file:', path) AS node FROM {requests} JOIN {nodes} ON root = occurrence")
register("g9_impact_radius", _radius, _BOXED + " SELECT * FROM radius")
register("g9_blast_summary", lambda x: ins.blast_summary(_radius(x), x.nodes, "/test_")[0], _BOXED + " SELECT query_id, count(*) FILTER (depth = 1) AS direct, count(*) AS within, count(DISTINCT path) AS files, count(DISTINCT path) FILTER (contains(path, '/test_')) AS test_files, count(*) FILTER (kind = 'route') AS routes FROM radius JOIN {nodes} ON occurrence = node GROUP BY query_id")
register("g9_blast_files", lambda x: ins.blast_summary(_radius(x), x.nodes, "/test_", 5)[1], _BOXED + " SELECT * FROM (SELECT query_id, path, count(*) AS symbols, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, path) AS no FROM radius JOIN {nodes} ON occurrence = node GROUP BY query_id, path) q WHERE no <= 5")
register("g12_type_relations", lambda x: ins.type_relations(x.edges, x.nodes, _roots(x)), """WITH r AS (SELECT query_id, CASE kind WHEN 'type_of' THEN 'types' WHEN 'returns' THEN 'returned' ELSE 'overrides' END AS role, target AS other FROM {requests} JOIN {edges} ON source = root AND kind IN ('type_of', 'returns', 'overrides')
UNION ALL SELECT query_id, 'referenced', target FROM {requests} JOIN {edges} e ON source = root AND e.kind = 'references' JOIN {nodes} n ON n.occurrence = target AND n.kind IN ('class', 'interface', 'enum')
UNION ALL SELECT query_id, CASE kind WHEN 'type_of' THEN 'users' ELSE 'returners' END, source FROM {requests} JOIN {edges} ON target = root AND kind IN ('type_of', 'returns')) SELECT query_id, role, other, count(*) AS edges FROM r GROUP BY 1, 2, 3""")
register("g4_impact_without_tests", lambda x: t.impact(x.edges, x.requests.select("query_id", F.col("root").alias("node")), 3, least=0.98, without=x.nodes.filter(F.col("path").contains("/test_")).select("occurrence")).select("query_id", "node", "depth"), """WITH RECURSIVE step AS (SELECT DISTINCT source AS s, target AS t FROM {edges} WHERE kind IN ('calls', 'references', 'extends', 'implements') AND (confidence IS NULL OR confidence >= 0.98) AND source NOT IN (SELECT occurrence FROM {nodes} WHERE contains(path, '/test_'))),
w AS (SELECT query_id, root AS node, 0 AS depth FROM {requests} UNION SELECT query_id, s, depth + 1 FROM w JOIN step ON t = node WHERE depth < 3) SELECT query_id, node, min(depth) AS depth FROM w GROUP BY query_id, node HAVING min(depth) > 0""")

_UND = f"""und AS (SELECT here, there, min(rank) AS rank FROM (SELECT source AS here, target AS there, {_RANK} AS rank FROM {{edges}} WHERE kind <> 'contains' UNION ALL SELECT target, source, {_RANK} FROM {{edges}} WHERE kind <> 'contains') q GROUP BY here, there)"""
_GROW = "{new} AS (SELECT * FROM {old} UNION ALL SELECT * FROM (SELECT query_id, node, '{role}' AS role, have + row_number() OVER (PARTITION BY query_id ORDER BY rank, node) AS place FROM (SELECT k.query_id, there AS node, min(rank) AS rank FROM {old} k JOIN {step} ON here = node GROUP BY ALL) c JOIN (SELECT query_id, count(*) AS have FROM {old} GROUP BY query_id) h USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM {old} o WHERE o.query_id = c.query_id AND o.node = c.node)) z WHERE place <= {most})"
_KEPT = (
    f"WITH {_UND}, typ AS (SELECT here, there, min(rank) AS rank FROM (SELECT source AS here, target AS there, {_RANK} AS rank FROM {{edges}} WHERE kind IN ('extends', 'implements') UNION ALL SELECT target, source, {_RANK} FROM {{edges}} WHERE kind IN ('extends', 'implements')) q GROUP BY here, there), "
    + "k0 AS (SELECT * FROM (SELECT query_id, occurrence AS node, 'entry' AS role, row_number() OVER (PARTITION BY query_id ORDER BY r) AS place FROM {hits} WHERE score >= 0.3) q WHERE place <= 3), "
    + ", ".join(_GROW.replace("{new}", n).replace("{old}", o).replace("{role}", r).replace("{step}", st).replace("{most}", m) for n, o, r, st, m in (("k1", "k0", "neighbor", "und", "9"), ("k2", "k1", "hierarchy", "typ", "12"), ("k3", "k2", "hierarchy", "typ", "12")))
)
register("g17_context", lambda x: ex.relevant_context(x.edges, x.hits, 12)[0], _KEPT + " SELECT * FROM k3")
register("g17_links", lambda x: ex.relevant_context(x.edges, x.hits, 12)[1], _KEPT + " SELECT DISTINCT a.query_id, source, target, kind FROM k3 a JOIN {edges} ON source = a.node JOIN k3 b ON b.query_id = a.query_id AND b.node = target WHERE kind <> 'contains'")
register(
    "g18_evidence_rank",
    lambda x: ex.evidence_rank(x.hits, x.nodes, x.terms),
    """WITH e AS (SELECT query_id, occurrence, r, sum(CASE WHEN contains(lower(concat(name, ' ', qualified_name)), term) THEN 1 WHEN term LIKE '%ing' AND length(term) > 5 AND contains(lower(concat(name, ' ', qualified_name)), left(term, -3)) THEN 2 ELSE 0 END)::BIGINT AS evidence
  FROM {hits} JOIN {nodes} USING (occurrence) JOIN {terms} USING (query_id) GROUP BY ALL)
SELECT query_id, occurrence, evidence, row_number() OVER (PARTITION BY query_id ORDER BY evidence DESC, r) AS place FROM e""",
)
_FLAGS = "SELECT query_id, occurrence, r, path LIKE '%.pb.go' AS generated, line % 2 = 0 AS ambient, contains(path, '/test_') AS test, line % 5 = 0 AS deprioritised FROM {hits} JOIN {nodes} USING (occurrence)"
register(
    "g18_exact_names",
    lambda x: ex.exact_name_rank(x.spark.sql(_FLAGS, hits=x.hits, nodes=x.nodes), x.described),
    f"""WITH f AS ({_FLAGS}), k AS (SELECT query_id, occurrence, r, lower(name) AS name, generated::INT + ambient::INT + test::INT + deprioritised::INT AS p, strlen(coalesce(signature, '')) + strlen(coalesce(documentation, '')) AS size FROM f JOIN {{described}} USING (occurrence)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY p, size, occurrence) AS no, row_number() OVER (PARTITION BY query_id, name ORDER BY r) AS seat FROM k)
SELECT a.query_id, a.occurrence, b.r AS place FROM n a JOIN n b ON a.query_id = b.query_id AND a.name = b.name AND a.no = b.seat""",
)
register("g19_code_priority", lambda x: ex.code_priority(x.nodes, x.edges, x.hits.filter("r <= 4").select("query_id", F.col("occurrence").alias("node")), 12, 10), f"""WITH {_UND}, ro AS (SELECT query_id, occurrence AS node, kind FROM {{hits}} JOIN {{nodes}} USING (occurrence) WHERE r <= 4),
ne AS (SELECT query_id, there AS node, CASE WHEN n.kind IN ('function', 'method') AND ro.kind IN ('function', 'method') THEN 1 WHEN n.kind = 'class' THEN 2 END AS priority, rank FROM ro JOIN und ON here = node JOIN {{nodes}} n ON n.occurrence = there),
be AS (SELECT query_id, node, min((priority, rank)) AS b FROM (SELECT query_id, node, 0 AS priority, 0 AS rank FROM ro UNION ALL SELECT * FROM ne WHERE priority IS NOT NULL) q GROUP BY query_id, node)
SELECT query_id, occurrence, priority, no, left(qualified_name, 10) AS shown FROM (SELECT query_id, node AS occurrence, b[1] AS priority, row_number() OVER (PARTITION BY query_id ORDER BY b[1], b[2], node) AS no FROM be) q JOIN {{nodes}} USING (occurrence) WHERE no <= 12""")
_CAND = "SELECT query_id, path, sum(score) AS score, CASE WHEN contains(path, '/test_') THEN 0.5 ELSE 1.0 END AS worth, min(r) = 7 AS pinned, min(r) = 5 AS spine, row_number() OVER (PARTITION BY query_id ORDER BY sum(score) DESC, path) AS place FROM {hits} JOIN {nodes} USING (occurrence) GROUP BY query_id, path"
_ALLOW = """c1 AS (SELECT *, greatest(score, 0) * least(greatest(worth, 0), 1) * CASE WHEN spine THEN 2 ELSE 1 END AS w0 FROM cand), c2 AS (SELECT *, CASE WHEN pinned THEN greatest(w0, max(w0) OVER q, 1) ELSE w0 END AS w FROM c1 WINDOW q AS (PARTITION BY query_id)), c3 AS (SELECT *, max(w) OVER (PARTITION BY query_id) AS top, pinned OR spine AS safe FROM c2),
c4 AS (SELECT *, safe OR w >= least(top * 0.15, 10) AS i0 FROM c3 WHERE top > 0), c5 AS (SELECT *, i0 AND sum(i0::INT) OVER (PARTITION BY query_id ORDER BY place) <= {most} AS i1 FROM c4),
c6 AS (SELECT *, i1 AND (safe OR sum(i1::INT) OVER (PARTITION BY query_id) <= {afford} OR row_number() OVER (PARTITION BY query_id, i1 ORDER BY w DESC, place) <= {afford}) AS i2 FROM c5), c7 AS (SELECT *, sum(i2::INT) OVER q AS n, sum(CASE WHEN i2 THEN w ELSE 0 END) OVER q AS total FROM c6 WINDOW q AS (PARTITION BY query_id)),
c8 AS (SELECT *, greatest({units} - 200 * n, 0) AS pool FROM c7), al AS (SELECT query_id, path, CASE WHEN i2 THEN least(floor(least(pool, 700 * n) / n) + floor((pool - least(pool, 700 * n)) * w / total), {ceiling}) ELSE 0 END::BIGINT AS allowance, NOT i2 AS cliffed FROM c8)"""
_allow = lambda units, most: _ALLOW.replace("{units}", str(units)).replace("{most}", str(most)).replace("{afford}", str(units // 900)).replace("{ceiling}", str(int(units * 0.7 + 0.5)))


def _cand(x: Facts) -> DataFrame:
    by = x.hits.join(x.nodes, "occurrence").groupBy("query_id", "path").agg(F.sum("score").alias("score"), F.min("r").alias("first"))
    return by.select("query_id", "path", "score", F.when(F.col("path").contains("/test_"), 0.5).otherwise(1.0).alias("worth"), (F.col("first") == 7).alias("pinned"), (F.col("first") == 5).alias("spine"), F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path)").alias("place"))


register("g20_allowances", lambda x: ex.allowances(_cand(x), 5000, 12), f"WITH cand AS ({_CAND}), {_allow(5000, 12)} SELECT * FROM al")
_PIN = "SELECT DISTINCT query_id, path FROM {requests} JOIN {nodes} ON occurrence = goal WHERE query_id % 5 = 0"
register("g21_explore", lambda x: ex.explore(x.nodes, x.edges, x.hits, x.spark.sql(_PIN, requests=x.requests, nodes=x.nodes), 1000, F.col("path").endswith(".pb.go"), F.col("path").contains("/test_")), f"""WITH {_UND}, o AS (SELECT query_id, occurrence, path, score, r FROM {{hits}} JOIN {{nodes}} USING (occurrence)), f AS (SELECT query_id, path, sum(score) AS score FROM o GROUP BY 1, 2),
ne AS (SELECT o.query_id, n.path, max(greatest(1, f.score * 0.25)) AS near FROM o JOIN f USING (query_id, path) JOIN und ON here = occurrence JOIN {{nodes}} n ON n.occurrence = there WHERE r <= 10 GROUP BY 1, 2), pi AS ({_PIN}),
a AS (SELECT query_id, path, round(greatest(coalesce(score, 0), coalesce(near, 0)), 6) AS score, CASE WHEN path LIKE '%.pb.go' THEN 0.3 WHEN contains(path, '/test_') THEN 0.5 ELSE 1 END::DOUBLE AS worth, pi.path IS NOT NULL AS pinned, false AS spine FROM f FULL JOIN ne USING (query_id, path) FULL JOIN pi USING (query_id, path)),
cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, score * worth DESC, path) AS place FROM a), {_allow(24000, 8)} SELECT query_id, path, score, worth, pinned, place, allowance, cliffed FROM cand JOIN al USING (query_id, path)""")


def _envelope(x: Facts) -> DataFrame:
    step = t.steps(x.edges, ["calls", "references", "extends", "implements"], "incoming", 0.98)
    roots = x.requests.select("query_id", F.col("root").alias("node"))
    reached = t.bfs(step, roots, 2)
    kept, lost = env.limited(reached.filter("depth > 0"), ["depth", "node"], 10, "node_limit")
    known = roots.join(x.nodes.select(F.col("occurrence").alias("node")), "node", "left_semi")
    out = env.answers(roots, kept, [lost, env.depth_limit(step, reached, 2), env.fanout_limit(step, reached, 12)], known)
    return out.select("query_id", "status", "partial", F.array_join("reasons", ",").alias("reasons"))


register("envelope_impact", _envelope, """WITH RECURSIVE step AS (SELECT DISTINCT target AS h, source AS t FROM {edges} WHERE kind IN ('calls', 'references', 'extends', 'implements') AND (confidence IS NULL OR confidence >= 0.98)),
w AS (SELECT query_id, root AS node, 0 AS depth FROM {requests} UNION SELECT query_id, t, depth + 1 FROM w JOIN step ON h = node WHERE depth < 2), m AS (SELECT query_id, node, min(depth) AS depth FROM w GROUP BY query_id, node),
why AS (SELECT query_id, 'node_limit' AS reason FROM m WHERE depth > 0 GROUP BY query_id HAVING count(*) > 10 UNION SELECT query_id, 'depth_limit' FROM m JOIN step ON h = node WHERE depth = 2 AND NOT EXISTS (SELECT 1 FROM m z WHERE z.query_id = m.query_id AND z.node = t)
UNION SELECT query_id, 'fanout_limit' FROM m WHERE node IN (SELECT h FROM step GROUP BY h HAVING count(*) > 12))
SELECT r.query_id, CASE WHEN root IN (SELECT occurrence FROM {nodes}) THEN 'ok' ELSE 'not_found' END AS status, count(reason) > 0 AS partial, coalesce(string_agg(reason, ',' ORDER BY reason), '') AS reasons FROM {requests} r LEFT JOIN why USING (query_id) GROUP BY r.query_id, root""")
register("c7_ranges_of_requests", lambda x: s.file_range(x.corpus, 1, 2, 1).select("path", "truncated"), "SELECT path, least(len(string_split(coalesce(text, ''), chr(10))), 2) > 1 AS truncated FROM {corpus}")
