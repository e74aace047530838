"""Registered queries over evidence, review, lifecycles, symbols and streams, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import lifecycle as lc
from ..operators import navigation as nav
from ..operators import review as r
from ..shipping import scratch
from ..streaming import maintain as mt
from ..streaming import streams as st
from .bindings import Facts
from .graph_queries import register
from .license_queries import _ASSESSED
from .lifecycle_queries import _GEN, _gen


def _sql(x: Facts, text: str, *tables: str) -> DataFrame:
    return x.spark.sql(text, **{k: getattr(x, k) for k in tables})


# projects whose parent is a third of their number; licences, missing properties and circles by rule
_POM = """SELECT k, concat('<project><parent><groupId>g</groupId><artifactId>a', CAST(CASE WHEN k % 50 = 7 THEN k ELSE CAST(floor(k / 3) AS BIGINT) END AS STRING), '</artifactId><version>', CASE WHEN k % 97 = 5 THEN concat('$', '{{gone}}') WHEN k % 2 = 0 THEN concat('$', '{{v}}') ELSE '1.0' END, '</version></parent><artifactId>a', CAST(k AS STRING), '</artifactId><version>1.0</version><properties><v>$', '{{w}}</v><w>1.0</w></properties>',
CASE WHEN p_size % 5 > 0 THEN '' WHEN k % 3 = 0 THEN '<licenses><license><name>The MIT License</name></license></licenses>' WHEN k % 3 = 1 THEN '<licenses><license><name>House licence</name></license></licenses>' ELSE '<licenses><license><name>A</name></license><license><name>B</name></license></licenses>' END, '</project>') AS body
FROM (SELECT CAST(p_partkey AS BIGINT) AS k, p_size FROM {part}) q"""


def _maven(x: Facts) -> DataFrame:
    body = F.when(F.col("k") < 3, F.regexp_replace("body", "<parent>.*</parent>", "<groupId>g</groupId>")).otherwise(F.col("body"))
    poms = _sql(x, _POM, "part").select("k", ev.parse_pom(body).alias("p")).select("k", "p.*")
    return ev.maven_licenses(poms, poms.select(F.col("k").alias("query_id"), "key"), {"The MIT License": "MIT"}, 4)


register("l5_maven", _maven, """WITH RECURSIVE p AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_size % 5 = 0 AS lic, CASE WHEN p_partkey % 50 = 7 AND p_partkey >= 3 THEN p_partkey WHEN p_partkey >= 3 THEN p_partkey // 3 END AS up, p_partkey % 97 = 5 AS gone FROM {part}),
w AS (SELECT k AS query_id, k AS cur, 0 AS steps, false AS back, true AS known, lic, up, gone FROM p UNION ALL SELECT query_id, w.up, steps + 1, w.up = cur, p.k IS NOT NULL, p.lic, p.up, p.gone FROM w LEFT JOIN p ON p.k = w.up WHERE NOT back AND known AND NOT w.lic AND w.up IS NOT NULL AND steps < 4 AND NOT w.gone),
e AS (SELECT *, CASE WHEN back THEN 'cyclic' WHEN NOT known THEN 'parent_missing' WHEN lic THEN 'resolved' WHEN up IS NULL THEN 'no_license' WHEN steps >= 4 THEN 'too_deep' WHEN gone THEN 'parent_unresolved' END AS outcome FROM w)
SELECT query_id, outcome, CASE WHEN outcome = 'resolved' THEN CASE cur % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'House licence' ELSE 'A; B' END END AS raw, steps FROM e WHERE outcome IS NOT NULL""")
register("l6_outcomes", lambda x: x.events.select("event_id", ev.outcome(F.when(F.col("event_type") == "error", 404).when(F.col("event_type") == "view", 503).otherwise(200), F.col("ts"), {"not_found": 7, "unavailable": 1, "malformed": 2}, F.col("event_id") % 10 == 0).alias("o")).select("event_id", "o.outcome", "o.expires_at"), "SELECT event_id, CASE WHEN event_type = 'error' THEN 'not_found' WHEN event_type = 'view' THEN 'unavailable' WHEN event_id % 10 = 0 THEN 'malformed' ELSE 'resolved' END AS outcome, CASE WHEN event_type = 'error' THEN ts + INTERVAL 7 DAY WHEN event_type = 'view' THEN ts + INTERVAL 1 DAY WHEN event_id % 10 = 0 THEN ts + INTERVAL 2 DAY END AS expires_at FROM {events}")
register("l9_evidence_history", lambda x: ev.evidence_history(x.snapshots, ["repository_id"], 1, 3).select("repository_id", "id", "no"), "SELECT * FROM (SELECT repository_id, id, row_number() OVER (PARTITION BY repository_id ORDER BY id DESC) AS no FROM {snapshots}) q WHERE no > 1 AND no <= 4")
_EVID = "SELECT ecosystem, namespace, name, CASE WHEN partkey % 3 > 0 THEN TIMESTAMP '2020-01-01 00:00:00' + (partkey % 100) * INTERVAL '1' DAY END AS expires_at FROM {components} WHERE status = 'resolved'"
register("l10_pending_enrichment", lambda x: lc.pending_enrichment(x.components, _sql(x, _EVID, "components"), "2020-02-01 00:00:00", x.components.filter("partkey % 50 = 0"), [f"Brand#{i}" for i in range(11, 20)]), f"""WITH e AS ({_EVID}) SELECT DISTINCT ecosystem, namespace, name FROM {{components}} c WHERE purl IS NOT NULL AND regexp_matches(ecosystem, '^Brand#1[1-9]$') AND NOT EXISTS (SELECT 1 FROM e WHERE (expires_at IS NULL OR expires_at >= TIMESTAMP '2020-02-01') AND e.ecosystem = c.ecosystem AND e.namespace = c.namespace AND e.name = c.name)
AND NOT EXISTS (SELECT 1 FROM {{components}} b WHERE b.partkey % 50 = 0 AND b.ecosystem = c.ecosystem AND b.namespace = c.namespace AND b.name = c.name)""")
_KEYED = "SELECT concat_ws('/', CAST(snapshot_id AS STRING), element_id) AS key, partkey % 7 AS repository_id, status AS fingerprint FROM {components}"
_RESULT = "SELECT concat_ws('/', CAST(snapshot_id AS STRING), element_id) AS key, partkey % 3 AS policy_id, 'resolved' AS fingerprint FROM {components} WHERE is_root"
_SET = "SELECT DISTINCT partkey % 7 AS repository_id, partkey % 7 % 3 AS policy_id FROM {components}"
register(
    "r4_pending",
    lambda x: r.pending_evaluation(_sql(x, _KEYED, "components"), _sql(x, _RESULT, "components"), _sql(x, _SET, "components")),
    f"""WITH c AS ({_KEYED}), p AS ({_RESULT}), a AS ({_SET})
    SELECT key, a.policy_id, c.fingerprint
    FROM c JOIN a USING (repository_id) LEFT JOIN p USING (key)
    WHERE p.policy_id IS NULL OR p.policy_id <> a.policy_id OR c.fingerprint IS DISTINCT FROM p.fingerprint""",
)
_OLD = "SELECT repository_id AS key, 1 AS policy_id, name AS verdict, CAST(fingerprint AS STRING) AS fingerprint, id FROM {decisions}"
_NEW = "SELECT repository_id AS key, 1 AS policy_id, CASE repository_id % 2 WHEN 0 THEN max_by(name, id) ELSE 'new' END AS verdict, CAST(max_by(fingerprint, id) AS STRING) AS fingerprint, max(id) + 1000000 AS id FROM {decisions} GROUP BY repository_id UNION ALL SELECT -1, 2, 'approved', 'x', CAST(1 AS BIGINT)"
register("r5_current_results", lambda x: r.current_results(_sql(x, _OLD, "decisions"), _sql(x, _NEW, "decisions")).select("key", "id", "current", "version"), f"""WITH o AS ({_OLD}), n AS ({_NEW}), l AS (SELECT key, max_by(verdict, id) AS v FROM o GROUP BY key), a AS (SELECT key, id FROM o UNION ALL SELECT n.key, n.id FROM n LEFT JOIN l USING (key) WHERE l.v IS NULL OR l.v <> n.verdict)
SELECT key, id, id = max(id) OVER (PARTITION BY key) AS current, row_number() OVER (PARTITION BY key ORDER BY id) AS version FROM a""")
register("r7_conclusions", lambda x: r.conclusion_history(x.decisions.select(F.col("repository_id").alias("key"), "id", F.col("fingerprint").alias("basis")), x.decisions.groupBy(F.col("repository_id").alias("key")).agg(F.max_by("fingerprint", "id").alias("fingerprint")).filter("key % 3 > 0"), 4), """SELECT repository_id AS key, id, no, repository_id % 3 > 0 AND fingerprint = last AS basis_holds FROM (SELECT *, row_number() OVER w AS no, first_value(fingerprint) OVER w AS last FROM {decisions} WINDOW w AS (PARTITION BY repository_id ORDER BY id DESC)) q WHERE no <= 4""")
_name = "CASE WHEN is_root THEN 'click' ELSE 'error' END"
register("r8_review_queue", lambda x: r.review_queue(x.components.join(x.snapshots.select(F.col("id").alias("snapshot_id"), "repository_id"), "snapshot_id").select("repository_id", F.expr(_name).alias("name"), (F.col("partkey") % 30).alias("fingerprint"), F.expr("CASE partkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'prohibited' END").alias("verdict"), "snapshot_id", "element_id"), x.decisions, "2024-01-20 00:00:00").select("snapshot_id", "element_id", "reason"), f"""WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, name ORDER BY id DESC) AS rn FROM {{decisions}}) q WHERE rn = 1)
SELECT snapshot_id, element_id, reason FROM (SELECT snapshot_id, element_id, CASE WHEN d.kind IS NULL THEN 'no decision' WHEN d.kind = 'exception' AND d.expires_at < TIMESTAMP '2024-01-20' THEN 'exception expired' WHEN d.fingerprint <> c.partkey % 30 THEN 'evidence changed' END AS reason
FROM {{components}} c JOIN {{snapshots}} s ON s.id = c.snapshot_id LEFT JOIN d ON d.repository_id = s.repository_id AND d.name = {_name} WHERE c.partkey % 4 > 0) q WHERE reason IS NOT NULL""")
register("r9_listing", lambda x: r.event_listing(x.decisions.select("id", "repository_id", F.col("created_at").alias("seen_at")), x.events.select(F.col("event_id").alias("id"), F.col("ts").alias("seen_at")), x.repositories.filter("enabled").select("id"), 30), "(SELECT 'review' AS listing, id, created_at AS seen_at FROM {decisions} WHERE repository_id IN (SELECT id FROM {repositories} WHERE enabled) ORDER BY created_at DESC, id DESC LIMIT 30) UNION ALL (SELECT 'audit', event_id, ts FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 30)")
_POLICY = "SELECT concat('p', CAST(repository_id AS STRING)) AS name, row_number() OVER (PARTITION BY repository_id ORDER BY id) AS version, id, id % 9 = 0 AS active FROM {decisions}"
register("r10_policy_versions", lambda x: r.policy_versions(_sql(x, _POLICY, "decisions")), f"WITH p AS ({_POLICY}) SELECT name, arg_max(id, version) AS id, max(version) AS version, max(version) FILTER (active) AS active, count(*) FILTER (active) > 1 AS conflict FROM p GROUP BY name")

_MANIFEST = "SELECT id, repository_id, CAST(1 + id % 2 AS INT) AS schema_version, CASE id % 3 WHEN 0 THEN 'external' WHEN 1 THEN 'scip' ELSE 'other' END AS source, id % 5 = 0 AS active FROM {snapshots}"
register("v3_manifest_precedence", lambda x: lc.manifest_precedence(_sql(x, _MANIFEST, "snapshots")), f"WITH m AS (SELECT *, CASE WHEN schema_version = 2 AND source = 'external' THEN 0 WHEN schema_version = 1 AND source <> 'scip' THEN 1 WHEN schema_version = 2 THEN 2 ELSE 3 END AS rank FROM ({_MANIFEST}) z) SELECT repository_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY rank, id DESC) AS r FROM m) q WHERE r = 1")
register("v4_readiness", lambda x: lc.readiness(x.repositories.select(F.col("id").alias("repository_id")), _gen(x), x.repositories.filter("id % 20 = 0").select(F.col("id").alias("repository_id"))), f"WITH g AS ({_GEN}), h AS (SELECT repository_id, bool_or(at_indexed_commit) AS ready FROM g GROUP BY 1), w AS (SELECT CASE WHEN id % 20 = 0 THEN id END AS repository_id, CASE WHEN ready IS NULL THEN 'graph_missing' WHEN NOT ready THEN 'graph_not_ready' END AS reason FROM {{repositories}} LEFT JOIN h ON h.repository_id = id) SELECT repository_id, reason, count(*) AS n FROM w WHERE reason IS NOT NULL GROUP BY 1, 2")
register("v5_repository_status", lambda x: lc.repository_status(x.repositories, _gen(x), _gen(x).filter("source = 'scip'")), f"WITH g AS ({_GEN}), h AS (SELECT repository_id, bool_or(at_indexed_commit) AS ready, bool_or(at_indexed_commit) FILTER (source = 'scip') AS sym FROM g GROUP BY 1) SELECT id, CASE WHEN ready IS NULL THEN 'absent' WHEN ready THEN 'current' ELSE 'stale' END AS state, CASE WHEN sym IS NULL THEN 'absent' WHEN sym THEN 'current' ELSE 'stale' END AS symbol_state FROM {{repositories}} LEFT JOIN h ON repository_id = id")
_IDX = "SELECT regexp_extract(path, '^src/([^/]*)', 1) AS upload_id, path, CAST(size AS STRING) AS hash FROM {files} WHERE language <> 'rust' OR path LIKE 'src/Brand#1%'"
_TREE = "SELECT regexp_extract(path, '^src/([^/]*)', 1) AS upload_id, path, CASE WHEN path NOT LIKE 'src/Brand#12/%2.go' THEN CAST(size + CASE WHEN path LIKE 'src/Brand#2%3.go' THEN 1 ELSE 0 END AS STRING) END AS hash FROM {files}"
register("v6_freshness_status", lambda x: lc.freshness_status(_sql(x, _IDX, "files"), _sql(x, _TREE, "files"), F.col("path").endswith("_5.go")), f"""WITH a AS ({_IDX}), b AS ({_TREE}), c AS (SELECT coalesce(a.upload_id, b.upload_id) AS upload_id, CASE WHEN a.path IS NULL THEN CASE WHEN b.path LIKE '%#_5.go' ESCAPE '#' THEN 'ignored' ELSE 'not_indexed' END WHEN a.hash IS NULL OR b.hash IS NULL THEN 'unverifiable' WHEN a.hash <> b.hash THEN 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path),
n AS (SELECT upload_id, count(*) FILTER (change = 'modified') AS modified, CAST(0 AS BIGINT) AS not_in_commit, count(*) FILTER (change = 'not_indexed') AS not_indexed, count(*) FILTER (change = 'unverifiable') AS unverifiable FROM c GROUP BY upload_id) SELECT *, CASE WHEN modified + not_indexed > 0 THEN 'stale' WHEN unverifiable > 0 THEN 'unverifiable' ELSE 'fresh' END AS status FROM n""")
register("v7_outranked", lambda x: lc.outranked(_sql(x, _MANIFEST, "snapshots"), _sql(x, _MANIFEST, "snapshots")), f"WITH m AS ({_MANIFEST}) SELECT id, repository_id FROM m WHERE schema_version = 1 AND source = 'scip' AND repository_id IN (SELECT repository_id FROM m WHERE schema_version = 2 AND source = 'scip' AND active)")
_STORED = "SELECT id, enabled, CAST(id % 10 AS STRING) AS head FROM {repositories} WHERE id % 7 > 0"
_UPSTREAM = "SELECT id, CASE WHEN id % 4 = 0 THEN 'moved' ELSE CAST(id % 10 AS STRING) END AS head FROM {repositories} WHERE id % 5 > 0"
register("v8_reconcile", lambda x: lc.reconcile(_sql(x, _STORED, "repositories"), _sql(x, _UPSTREAM, "repositories")), f"WITH s AS ({_STORED}), u AS ({_UPSTREAM}) SELECT id, CASE WHEN enabled IS NULL THEN 'insert' WHEN u.head IS NULL THEN CASE WHEN enabled THEN 'disable' ELSE 'keep' END WHEN NOT enabled THEN 'enable' WHEN s.head <> u.head THEN 'update' ELSE 'keep' END AS action, coalesce(s.head <> u.head, false) AS head_changed FROM s FULL JOIN u USING (id)")
register("v9_repositories", lambda x: ev.page(x.repositories.filter("enabled").select("name", "id", "status"), ["name", "id"], ("Customer#000000100", 0), 50), "SELECT name, id, status FROM {repositories} WHERE enabled AND (name > 'Customer#000000100' OR name = 'Customer#000000100' AND id > 0) ORDER BY name, id LIMIT 50")
register("v9_deliveries", lambda x: ev.page(x.events.select((-F.col("event_id")).alias("newest"), "event_type"), ["newest"], (-500,), 20), "SELECT -event_id AS newest, event_type FROM {events} WHERE event_id < 500 ORDER BY newest LIMIT 20")
register("v9_uploads", lambda x: x.snapshots.groupBy("repository_id").agg(F.count("*").alias("uploads"), F.max("id").alias("latest")), "SELECT repository_id, count(*) AS uploads, max(id) AS latest FROM {snapshots} GROUP BY 1")

_LINK = "SELECT snapshot_id, element_id AS to_element FROM {components} WHERE NOT is_root AND partkey % 3 > 0"
_MAP = "SELECT DISTINCT repository_id, CASE WHEN is_root THEN 'provides' ELSE 'depends_on' END AS relation, purl FROM {components} c JOIN {snapshots} s ON s.id = c.snapshot_id WHERE purl IS NOT NULL AND (is_root OR partkey % 3 > 0)"
_mapping = lambda x: lc.package_mapping(x.components, x.snapshots, _sql(x, _LINK, "components"))
register("n9_package_mapping", _mapping, _MAP)
_MANUAL = "SELECT repository_id, relation, purl, CASE WHEN repository_id % 4 = 0 THEN 'manual' ELSE 'automatic' END AS source FROM"
register("n9_replace", lambda x: lc.replace_mapping(_mapping(x).withColumn("source", F.expr("CASE WHEN repository_id % 4 = 0 THEN 'manual' ELSE 'automatic' END")), _mapping(x).filter("repository_id % 2 = 0 AND relation = 'provides'")), f"WITH m AS ({_MAP}), c AS (SELECT * FROM m WHERE repository_id % 2 = 0 AND relation = 'provides') SELECT * FROM ({_MANUAL} m) z WHERE NOT (source = 'automatic' AND repository_id IN (SELECT repository_id FROM c)) UNION ALL SELECT *, 'automatic' FROM c")
_ASK = "SELECT snapshot_id * 100 + partkey % 100 AS query_id, repository_id, purl AS package, name AS symbol_key FROM {components} c JOIN {snapshots} s ON s.id = c.snapshot_id WHERE purl IS NOT NULL AND partkey % 11 = 0"
_PLACE = "SELECT repository_id + 1000 AS upload_id, namespace AS path, name AS symbol_key, CAST(partkey % 40 AS INT) AS line FROM {components} c JOIN {snapshots} s ON s.id = c.snapshot_id WHERE is_root"
register("n3_approximate", lambda x: lc.approximate_locations(_sql(x, "SELECT DISTINCT * FROM (" + _ASK + ") z", "components", "snapshots"), _sql(x, _ASK, "components", "snapshots").filter("query_id % 3 = 0"), _mapping(x).select("repository_id", "relation", F.col("purl").alias("package"), F.expr("CASE WHEN repository_id % 4 = 0 THEN 'manual' ELSE 'automatic' END").alias("source")), x.repositories.select(F.col("id").alias("repository_id"), (F.col("id") + 1000).alias("upload_id")), _sql(x, _PLACE, "components", "snapshots"), 5), f"""WITH m AS ({_MAP}), q AS (SELECT DISTINCT * FROM ({_ASK}) z WHERE query_id % 3 > 0), pl AS ({_PLACE}), g AS (SELECT purl AS package, min((CASE WHEN repository_id % 4 = 0 THEN 0 ELSE 1 END, repository_id))[2] AS provider FROM m WHERE relation = 'provides' GROUP BY purl),
h AS (SELECT DISTINCT query_id, provider, path, line FROM q JOIN g USING (package) JOIN pl USING (symbol_key) WHERE upload_id = provider + 1000 AND provider IN (SELECT id FROM {{repositories}}) AND (repository_id, package) IN (SELECT repository_id, purl FROM m WHERE relation = 'depends_on')) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path, line) AS no FROM h) z WHERE no <= 5""")
_METHODS = "SELECT p_brand AS package, concat(CASE WHEN p_size % 4 = 0 THEN 'I' ELSE 'C' END, CAST(p_partkey % 60 AS STRING)) AS owner, CASE WHEN p_size % 4 = 0 THEN 'interface' ELSE 'class' END AS kind, concat('m', CAST(p_size % 3 AS STRING)) AS name, CAST(p_partkey % 2 AS STRING) AS signature FROM {part}"
_EMBEDS = "SELECT concat('Brand#', CAST(11 + n_nationkey % 15 + 10 * k AS STRING)) AS package, concat('I', CAST(n_nationkey AS STRING)) AS interface, concat('I', CAST(n_nationkey + 20 AS STRING)) AS embedded FROM {nation} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) q"
register("n8_satisfies", lambda x: lc.satisfies(_sql(x, _METHODS, "part"), _sql(x, _EMBEDS, "nation")).distinct(), f"""WITH RECURSIVE me AS ({_METHODS}), em AS ({_EMBEDS}), a AS (SELECT package, owner AS interface, concat(name, '#', signature) AS m FROM me WHERE kind = 'interface' UNION SELECT a.package, em.interface, m FROM a JOIN em ON em.embedded = a.interface AND em.package = a.package),
h AS (SELECT DISTINCT package, owner AS type, concat(name, '#', signature) AS m FROM me WHERE kind = 'class'), n AS (SELECT package, interface, count(*) AS need FROM a GROUP BY 1, 2)
SELECT DISTINCT type, interface FROM (SELECT package, type, interface, count(*) AS got FROM h JOIN a USING (package, m) GROUP BY ALL) g JOIN n USING (package, interface) WHERE got = need""")
_REFS = "SELECT CAST(event_id AS BIGINT) AS reference_id, concat('src/', p_brand, '/f', CAST(event_id % 4 AS STRING)) AS path, p_brand AS module, p_name AS name, CASE WHEN event_id % 13 = 0 THEN concat('s', CAST(p_partkey AS STRING)) END AS symbol, concat('part:', CAST(user_id AS STRING)) AS source, CASE WHEN event_id % 5 = 0 THEN 'imports' ELSE 'calls' END AS kind FROM {events} JOIN {part} ON p_partkey = (event_id * 7) % 2000"
_DECL = "SELECT concat('part:', CAST(p_partkey AS STRING)) AS occurrence, concat('src/', p_brand, '/f', CAST(p_size % 4 AS STRING)) AS path, p_brand AS module, p_name AS name, concat('s', CAST(p_partkey AS STRING)) AS symbol FROM {part}"
_IMPORT = "SELECT concat('src/', p_brand, '/f', CAST(p_size % 4 AS STRING)) AS path, concat('Brand#', CAST(11 + p_partkey % 40 AS STRING)) AS module, CASE WHEN p_size % 3 > 0 THEN p_name END AS name, CAST(NULL AS STRING) AS alias FROM {part} WHERE p_partkey % 6 = 0"
_CANDIDATES = f"""r AS ({_REFS}), d AS ({_DECL}), i AS ({_IMPORT}), c AS (SELECT DISTINCT reference_id, 1 AS tier, occurrence AS target FROM r JOIN d USING (symbol) UNION SELECT reference_id, 2, occurrence FROM r JOIN i ON i.path = r.path AND i.name = r.name JOIN d ON d.module = i.module AND d.name = i.name UNION SELECT reference_id, 3, occurrence FROM r JOIN i ON i.path = r.path AND i.name IS NULL JOIN d ON d.module = i.module AND d.name = r.name
UNION SELECT reference_id, 4, occurrence FROM r JOIN d ON d.path = r.path AND d.name = r.name UNION SELECT reference_id, 5, occurrence FROM r JOIN d ON d.module = r.module AND d.name = r.name), o AS (SELECT reference_id, tier, min(target) AS target FROM c GROUP BY 1, 2 HAVING count(*) = 1), best AS (SELECT reference_id, min(tier) AS tier, arg_min(target, tier) AS target FROM o GROUP BY 1)"""


def _resolved(x: Facts) -> tuple[DataFrame, DataFrame]:
    refs = _sql(x, _REFS, "events", "part")
    return refs, lc.resolve(refs, _sql(x, _DECL, "part"), _sql(x, _IMPORT, "part"))


register("n7_resolve", lambda x: _resolved(x)[1], f"WITH {_CANDIDATES} SELECT * FROM best")
register("n7_edges", lambda x: lc.resolved_edges(*_resolved(x)), f"WITH {_CANDIDATES} SELECT DISTINCT source, target, kind, CASE kind WHEN 'imports' THEN 1.0 ELSE 0.9 END::DOUBLE AS confidence FROM best JOIN r USING (reference_id)")

_SYMBOL = "CASE WHEN {0} % 3 = 0 THEN concat('p T', CAST({0} AS STRING), '#') ELSE concat('p T', CAST({0} - {0} % 3 AS STRING), '#m', CAST({0} AS STRING), '.') END"
_OCC = "SELECT CAST(l_suppkey % 5 AS BIGINT) AS upload_id, concat(l_returnflag, CAST(l_orderkey % 3 AS STRING)) AS path, CAST(l_orderkey % 90 AS INT) AS start_line, CAST(l_linenumber AS INT) AS start_character, CAST(l_orderkey % 90 AS INT) AS end_line, " + _SYMBOL.format("l_partkey") + " AS symbol, CASE WHEN l_linestatus = 'F' AND l_quantity < 5 THEN 1 ELSE 0 END AS roles, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_orderkey % 90 + 3 AS INT) END AS to_line FROM {lineitem}"
_REL = "SELECT CAST(p_size % 5 AS BIGINT) AS upload_id, " + _SYMBOL.format("p_partkey") + " AS source_symbol, " + _SYMBOL.format("(p_partkey * 3)") + " AS target_symbol, p_size % 2 = 0 AS is_implementation, p_size % 3 = 0 AS is_reference, p_size % 4 = 0 AS is_type_definition FROM {part}"
_SYMS = "SELECT " + _SYMBOL.format("p_partkey") + " AS symbol, CASE WHEN p_partkey % 21 = 0 THEN 'Module' WHEN p_partkey % 3 = 0 THEN 'Class' WHEN p_partkey % 3 = 1 THEN 'Method' ELSE 'Odd' END AS kind FROM {part}"
_KINDS = {"Module": "module", "Class": "class", "Method": "method"}
_graph = lambda x, legacy=False: nav.symbol_graph(_sql(x, _OCC, "lineitem"), _sql(x, _REL, "part"), _sql(x, _SYMS, "part"), _KINDS, legacy)
_SCIP = f"""WITH oc AS ({_OCC}), re AS ({_REL}), sy AS ({_SYMS}), df AS (SELECT upload_id, symbol, min((path, start_line, start_character, coalesce(to_line, -1))) AS d FROM oc WHERE roles = 1 GROUP BY 1, 2),
sym AS (SELECT upload_id, symbol, CASE kind WHEN 'Module' THEN 'module' WHEN 'Class' THEN 'class' WHEN 'Method' THEN 'method' ELSE 'variable' END AS kind, d[1] AS path, d[2] AS line, nullif(d[4], -1) AS to_line FROM df LEFT JOIN sy USING (symbol)),
up AS (SELECT s.*, CASE WHEN a.symbol IS NOT NULL THEN a.symbol ELSE concat('file:', s.path) END AS above FROM sym s LEFT JOIN sym a ON a.upload_id = s.upload_id AND contains(s.symbol, '#m') AND a.symbol = regexp_extract(s.symbol, '^[^#]*#')),
rf AS (SELECT DISTINCT o.upload_id, o.path, start_line AS line, o.symbol, s.kind FROM oc o JOIN sym s USING (upload_id, symbol) WHERE roles = 0),
en AS (SELECT r.*, (SELECT arg_max(d.symbol, (d.line, -d.to_line, d.symbol)) FROM sym d WHERE d.upload_id = r.upload_id AND d.path = r.path AND d.to_line IS NOT NULL AND d.line <= r.line AND r.line <= d.to_line) AS inside FROM rf r),
ed AS (SELECT upload_id, above AS source, 'contains' AS kind, symbol AS target FROM up {{more}} UNION SELECT upload_id, coalesce(inside, concat('file:', path)), 'references', symbol FROM en WHERE {{keep}} coalesce(inside, '') <> symbol
UNION SELECT r.upload_id, source_symbol, unnest(list_filter([CASE WHEN is_implementation THEN 'implements' END, CASE WHEN is_reference THEN 'references' END, {{types}}], lambda k: k IS NOT NULL)), target_symbol FROM re r JOIN sym a ON a.upload_id = r.upload_id AND a.symbol = source_symbol JOIN sym b ON b.upload_id = r.upload_id AND b.symbol = target_symbol)"""
_FULL = _SCIP.replace("{more}", "UNION SELECT upload_id, concat('file:', path), 'imports', symbol FROM rf WHERE kind = 'module'").replace("{keep}", "kind <> 'module' AND").replace("{types}", "CASE WHEN is_type_definition THEN 'type_of' END")
_LEGACY = _SCIP.replace("{more}", "").replace("{keep}", "").replace("{types}", "CASE WHEN is_implementation AND a.kind = 'class' AND b.kind = 'class' THEN 'extends' END")
register("n5_symbol_nodes", lambda x: _graph(x)[0], _FULL + " SELECT upload_id, symbol AS occurrence, kind, path, line FROM sym UNION ALL SELECT DISTINCT upload_id, concat('file:', path), 'file', path, 0 FROM oc")
register("n5_symbol_edges", lambda x: _graph(x)[1], _FULL + " SELECT * FROM ed")
register("n6_legacy_edges", lambda x: _graph(x, True)[1], _LEGACY + " SELECT * FROM ed")

_events = lambda x: st.source(x.spark, x.sf_dir, "events")
_keyed = lambda x: _events(x).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "event_type", "value", "ts")


def _ended(x: Facts, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The whole result of an ordered stream over the events, which come to an end."""
    end = scratch(x.spark, "end")
    return st.drain(build(st.closed(_keyed(x), end)), end=end)


register("t2_targets", lambda x: _ended(x, lambda e: st.coalesced_targets(e.select("key", "id", "ts", F.col("event_type").alias("target")))), "SELECT user_id AS key, event_id AS id, event_type AS target, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 'same' ELSE 'queued' END AS outcome FROM {events}")
register("t3_publications", lambda x: _ended(x, lambda e: st.publications(e.select("key", "id", "ts", F.when(F.col("event_type") != "error", F.sha2((F.floor("value") % 3).cast("string"), 256)).alias("digest")))), """WITH o AS (SELECT user_id AS key, event_id AS id, floor(value)::BIGINT % 3 AS d FROM {events} WHERE event_type <> 'error')
SELECT key, id, CASE WHEN lag(d) OVER (PARTITION BY key ORDER BY id) = d THEN 'unchanged' ELSE 'published' END AS outcome FROM o UNION ALL SELECT user_id, event_id, 'failed' FROM {events} WHERE event_type = 'error'""")
register("t4_import_once", lambda x: st.drain(st.imports_once(_keyed(x).select("key", (F.floor("value") % 5).alias("digest"), "ts", (F.col("event_type") != "error").alias("accepted")))).select("key", "digest"), "SELECT DISTINCT user_id AS key, floor(value)::BIGINT % 5 AS digest FROM {events} WHERE event_type <> 'error'")
register("t6_pointers", lambda x: st.drain(st.pointers(_events(x), "user_id", "ts", "event_id", F.col("event_type") != "error"), "complete").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_at", "last_success_at")}), "SELECT user_id, max(ts) AS last_at, max(event_id) AS last_id, count(*) AS n, max(ts) FILTER (event_type <> 'error') AS last_success_at, arg_max(event_type <> 'error', event_id) AS last_good FROM {events} GROUP BY user_id")


def _maintained(x: Facts) -> str:
    """Evidence that comes in four batches, assessed as it comes; the folder of what is known then."""
    folder = scratch(x.spark, "assessed")
    for part in range(4):
        x.registry.filter(F.col("id") % 4 == part).repartition(2).write.parquet(f"{folder}/arrivals/part={part}")
    arrivals = x.spark.readStream.schema(x.registry.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/arrivals/part=*")
    mt.run(mt.reassessed(arrivals, x.components.select("snapshot_id", "element_id", (F.col("partkey") % 200).alias("coordinate")), folder, ["coordinate"]))
    return folder


register(
    "t7_maintained",
    lambda x: mt.occurrences(x.spark, _maintained(x)).select("snapshot_id", "element_id", "coordinate", "status", "expression"),
    f"WITH z AS ({_ASSESSED}) SELECT snapshot_id, element_id, partkey % 200 AS coordinate, z.status, z.expression FROM {{components}} JOIN z ON coordinate = partkey % 200",
)
