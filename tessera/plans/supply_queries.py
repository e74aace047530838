"""Registered queries over inventories, reviews, lifecycles and text search, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import portfolio as p
from ..operators import review as r
from ..operators import search as s
from .bindings import Facts
from .graph_queries import register

NOW = "2002-06-01 00:00:00"

_REPOS = "repos AS (SELECT * FROM {repositories} WHERE enabled AND NOT archived)"
_LATEST = _REPOS + ", latest AS (SELECT repository_id, stream_key, max(id) AS snapshot_id, max_by(collected_at, id) AS collected_at, max_by(outcome, id) AS outcome FROM {snapshots} WHERE repository_id IN (SELECT id FROM repos) GROUP BY repository_id, stream_key)"


def _latest(x: Facts) -> DataFrame:
    return p.latest_snapshots(x.snapshots, p.authorised(x.repositories))


register("v1_authorised", lambda x: p.authorised(x.repositories, x.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("id"))).select("id", "name"), "SELECT id, name FROM {repositories} WHERE enabled AND NOT archived AND installation_id IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey < 3)")
register("p1_latest", _latest, f"WITH {_LATEST} SELECT * FROM latest")
register("p3_by_ecosystem", lambda x: p.coordinates_by_ecosystem(x.components), """SELECT ecosystem, sum(n)::BIGINT AS occurrences, count(*) AS coordinates, sum(b)::BIGINT AS without_purl, sum(CASE WHEN version IS NULL THEN n ELSE 0 END)::BIGINT AS without_version FROM
(SELECT ecosystem, namespace, name, version, count(*) AS n, count(*) FILTER (purl IS NULL) AS b FROM {components} GROUP BY ALL) q GROUP BY ecosystem""")
register("p6_facets", lambda x: p.facets(x.components, {"ecosystem": 10, "status": 20, "license_raw": 50}), """WITH v AS (SELECT 'ecosystem' AS facet, ecosystem AS value FROM {components} UNION ALL SELECT 'status', coalesce(status, 'unassessed') FROM {components} UNION ALL SELECT 'license_raw', coalesce(license_raw, 'none') FROM {components}),
c AS (SELECT facet, value, count(*) AS n FROM v GROUP BY facet, value), k AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rn FROM c) SELECT facet, value, n FROM k WHERE rn <= CASE facet WHEN 'ecosystem' THEN 10 WHEN 'status' THEN 20 ELSE 50 END""")
_WANT = "SELECT p_brand AS ecosystem, p_type AS namespace, p_name AS name, 'R1' AS version FROM {part}"
register("p7_occurrences", lambda x: p.occurrences_of(x.components, _latest(x), x.part.select(F.col("p_brand").alias("ecosystem"), F.col("p_type").alias("namespace"), F.col("p_name").alias("name"), F.lit("R1").alias("version"))), f"WITH {_LATEST} SELECT repository_id, snapshot_id, element_id, is_root, status FROM {{components}} JOIN latest USING (snapshot_id) WHERE version = 'R1'")
register("p11_compare", lambda x: p.compare(x.components.filter("snapshot_id % 2 = 0"), x.components.filter("snapshot_id % 2 = 1"), ["ecosystem"]), """WITH o AS (SELECT ecosystem, namespace, name, coalesce(version, '') AS v, min(license_raw) AS l FROM {components} WHERE snapshot_id % 2 = 0 GROUP BY ALL), n AS (SELECT ecosystem, namespace, name, coalesce(version, '') AS v, min(license_raw) AS l FROM {components} WHERE snapshot_id % 2 = 1 GROUP BY ALL)
SELECT ecosystem, change, count(*) AS n FROM (SELECT ecosystem, CASE WHEN NOT ino THEN 'added' WHEN NOT inn THEN 'removed' WHEN ol IS DISTINCT FROM nl THEN 'license_changed' END AS change FROM
(SELECT coalesce(o.ecosystem, n.ecosystem) AS ecosystem, o.ecosystem IS NOT NULL AS ino, n.ecosystem IS NOT NULL AS inn, o.l AS ol, n.l AS nl FROM o FULL JOIN n USING (ecosystem, namespace, name, v)) q) w WHERE change IS NOT NULL GROUP BY ecosystem, change""")
register("p12_inventory_status", lambda x: p.inventory_status(p.authorised(x.repositories), _latest(x), NOW, 400, x.components), f"""WITH {_LATEST}, lc AS (SELECT repository_id AS id, count(*) AS components, count(*) FILTER (trim(license_raw) <> '') AS licensed FROM {{components}} JOIN latest USING (snapshot_id) GROUP BY 1), st AS (SELECT repository_id, max(collected_at) AS seen_at, arg_max(outcome, (collected_at, snapshot_id)) AS outcome FROM latest GROUP BY repository_id)
SELECT id, CASE WHEN seen_at IS NULL THEN 'never' WHEN outcome = 'failed' THEN 'failed' WHEN epoch(TIMESTAMP '{NOW}') - epoch(seen_at) > 400 * 86400 THEN 'stale' ELSE 'current' END AS state, CAST(epoch(TIMESTAMP '{NOW}') - epoch(seen_at) AS BIGINT) AS age, coalesce(components, 0) AS components, coalesce(licensed, 0) AS licensed FROM repos LEFT JOIN st ON repository_id = id LEFT JOIN lc USING (id)""")
register("p13_history", lambda x: p.history(x.snapshots, 3), "SELECT * FROM (SELECT repository_id, id, outcome, row_number() OVER (PARTITION BY repository_id ORDER BY id DESC) AS no FROM {snapshots}) q WHERE no <= 3")
register("p14_retention", lambda x: p.retention(x.snapshots, 2, [x.components.filter("status = 'conflict'").select(F.col("snapshot_id").alias("id"))]), "SELECT id, repository_id, stream_key FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, stream_key ORDER BY id DESC) AS no FROM {snapshots}) q WHERE no > 2 AND id NOT IN (SELECT snapshot_id FROM {components} WHERE status = 'conflict')")
register("p17_share_links", lambda x: p.share_links(x.components.join(_latest(x), "snapshot_id").groupBy("ecosystem").agg(F.collect_set("repository_id").alias("ids")), "ecosystem", "ids", 1000).select("ecosystem", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids")), f"""WITH {_LATEST}, d AS (SELECT DISTINCT ecosystem, repository_id FROM {{components}} JOIN latest USING (snapshot_id)), k AS (SELECT *, row_number() OVER (PARTITION BY ecosystem ORDER BY repository_id) AS rn, count(*) OVER () AS total FROM d)
SELECT ecosystem, string_agg(repository_id, ',' ORDER BY repository_id) AS ids FROM k WHERE total <= 1000 OR rn <= greatest(floor(1000 / (SELECT count(DISTINCT ecosystem) FROM d)), 1) GROUP BY ecosystem""")
register("p20_assessed", lambda x: p.assessed_share(x.components, _latest(x)), f'WITH {_LATEST} SELECT repository_id, count(status) AS assessed, count(*) AS "all", count(status) / count(*) AS share FROM {{components}} JOIN latest USING (snapshot_id) GROUP BY 1')
register("s12_csv_cells", lambda x: x.conversations.select("conv_id", "turn", p.csv_cell("text").alias("cell")), "SELECT conv_id, turn, CASE WHEN regexp_matches(coalesce(text, ''), '^[=+\\-@\\t\\r|%]') THEN '''' || text ELSE coalesce(text, '') END AS cell FROM {conversations}")
register("l1_raw_kind", lambda x: x.components.groupBy(r.raw_kind(F.col("license_raw")).alias("kind")).agg(F.count("*").alias("n")), "SELECT CASE WHEN license_raw IS NULL THEN 'missing' WHEN upper(trim(license_raw)) IN ('NOASSERTION', 'UNLICENSED') THEN 'sentinel' ELSE 'expression' END AS kind, count(*) AS n FROM {components} GROUP BY 1")
register("l8_changed_evidence", lambda x: r.changed_evidence(x.snapshots, ["repository_id", "stream_key"], "outcome", "id").select("id", "outcome"), "SELECT id, outcome FROM (SELECT *, lag(outcome) OVER w AS b, row_number() OVER w AS no FROM {snapshots} WINDOW w AS (PARTITION BY repository_id, stream_key ORDER BY id)) q WHERE no = 1 OR b IS DISTINCT FROM outcome")
register("l7_latest_evidence", lambda x: r.latest_evidence(x.snapshots, ["repository_id"]).select("repository_id", "id", "outcome"), """WITH n AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY id DESC) AS no FROM {snapshots}), g AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY id DESC) AS no FROM {snapshots} WHERE outcome <> 'failed')
SELECT repository_id, id, outcome FROM n WHERE no = 1 UNION ALL SELECT repository_id, id, outcome FROM g WHERE no = 1 AND repository_id IN (SELECT repository_id FROM n WHERE no = 1 AND outcome = 'failed')""")
register("l13_assessment_counts", lambda x: x.components.groupBy("snapshot_id", F.coalesce("status", F.lit("unassessed")).alias("status")).agg(F.count("*").alias("n")), "SELECT snapshot_id, coalesce(status, 'unassessed') AS status, count(*) AS n FROM {components} GROUP BY 1, 2")
register("r6_superseded", lambda x: r.superseded(x.decisions, ["repository_id", "name"]).select("id", "superseded_by"), "SELECT id, lead(id) OVER (PARTITION BY repository_id, name ORDER BY id) AS superseded_by FROM {decisions}")
register("c1_literal_search", lambda x: s.search(x.corpus, "the and", context=0).select("path", "line_no"), """SELECT path, line_no FROM (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {corpus}) q WHERE contains(lower(line), 'the') AND contains(lower(line), 'and')""")
register("c1_regex_search", lambda x: s.search(x.corpus, "th[a-e]+r", regex=True, case=True, context=0).select("path", "line_no"), """SELECT path, line_no FROM (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {corpus}) q WHERE regexp_matches(line, 'th[a-e]+r')""")
register("c4_preview", lambda x: s.search(x.corpus, "license", context=1).select("path", "line_no", F.sha2("preview", 256).alias("preview")), """SELECT path, line_no, sha256(array_to_string(list_slice(parts, greatest(line_no - 1, 1), line_no + 1), chr(10))) AS preview FROM (SELECT path, parts, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM (SELECT path, string_split(text, chr(10)) AS parts FROM {corpus}) a) q WHERE contains(lower(line), 'license')""")
register("c7_file_range", lambda x: s.file_range(x.corpus, 2, 6, 3).select("path", F.sha2("content", 256).alias("content"), "truncated", "out_of_range"), """SELECT path, sha256(array_to_string(list_slice(parts, 2, 4), chr(10))) AS content, least(len(parts), 6) - 1 > 3 AS truncated, len(parts) < 2 AS out_of_range FROM (SELECT path, string_split(coalesce(text, ''), chr(10)) AS parts FROM {corpus}) q""")
