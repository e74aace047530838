"""Registered queries over registry evidence, histories and pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..shipping import durable
from ..operators import lifecycle as lc
from .graph_queries import register

_NPM = """SELECT occurrence, CASE ordinal % 4 WHEN 0 THEN concat('{{"version":"1.0","license":"MIT"}}') WHEN 1 THEN '{{"version":"1.0","license":{{"type":"BSD"}}}}' WHEN 2 THEN '{{"version":"2.0","license":"ISC"}}' ELSE '{{"version":"1.0","license":"SEE LICENSE IN LICENSE.txt"}}' END AS body FROM {entities}"""
register("l3_npm", lambda x: x.spark.sql(_NPM, entities=x.entities).select("occurrence", ev.npm_license(F.col("body"), F.lit("1.0")).alias("l")).select("occurrence", "l.raw", "l.kind"), "SELECT occurrence, CASE ordinal % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'BSD' WHEN 2 THEN 'ISC' ELSE 'SEE LICENSE IN LICENSE.txt' END AS raw, CASE ordinal % 4 WHEN 0 THEN 'expression' WHEN 1 THEN 'legacy_object' WHEN 2 THEN 'rejected' ELSE 'file' END AS kind FROM {entities}")
register("l4_nuspec", lambda x: x.entities.select("occurrence", "ordinal", F.concat(F.lit("<package><metadata><id>"), F.upper("language"), F.lit("</id><version>1.0</version>"), F.when(F.col("ordinal") % 3 == 0, "<license type=\"expression\">MIT</license>").when(F.col("ordinal") % 3 == 1, "<licenseUrl>https://x/y</licenseUrl>").otherwise(""), F.lit("</metadata></package>")).alias("body"), "language").select("occurrence", ev.nuspec_license(F.col("body"), F.col("language"), F.lit("1.0")).alias("l")).select("occurrence", "l.raw", "l.kind"), "SELECT occurrence, CASE ordinal % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'https://x/y' END AS raw, CASE ordinal % 3 WHEN 0 THEN 'expression' WHEN 1 THEN 'url' ELSE 'missing' END AS kind FROM {entities}")
register("l12_human", lambda x: ev.with_human(x.decisions.select("repository_id", "id", (F.col("kind") == "exception").alias("human"), F.col("name").alias("value")), ["repository_id"]), """SELECT repository_id, coalesce(h, m) AS value, h <> m AS disagrees FROM (SELECT repository_id, arg_max(name, id) FILTER (kind = 'exception') AS h, arg_max(name, id) FILTER (kind <> 'exception') AS m FROM {decisions} GROUP BY 1) q""")
register("e15_page", lambda x: ev.page(x.nodes.select("path", "occurrence"), ["path", "occurrence"], ("src/Brand#12", ""), 40), "SELECT path, occurrence FROM {nodes} WHERE path > 'src/Brand#12' OR (path = 'src/Brand#12' AND occurrence > '') ORDER BY path, occurrence LIMIT 40")


def _bound(x: Facts) -> DataFrame:
    """First pages by language, then what their cursors give: the same question, a changed filter, a broken cursor."""
    ask = x.nation.select(F.col("n_nationkey").cast("int").alias("query_id"), F.lit("all").alias("scope"), F.element_at(F.array(*map(F.lit, ("go", "java", "rust", "python"))), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("filter"))
    matched = durable(ask.join(x.nodes.filter("line % 5 = 0").select(F.col("language").alias("filter"), "path", "occurrence"), "filter").select("query_id", "path", "occurrence"))
    first = durable(ev.bound_pages(ask.withColumn("cursor", F.lit(None).cast("string")), matched, ["path", "occurrence"], 7))
    given = first.filter("next_cursor IS NOT NULL").select("query_id", F.col("next_cursor").alias("cursor"))
    k = F.col("query_id") % 3
    again = ask.join(given, "query_id").withColumn("filter", F.when(k == 1, "other").otherwise(F.col("filter"))).withColumn("cursor", F.when(k == 2, "not a cursor").otherwise(F.col("cursor")))
    return ev.bound_pages(again, matched, ["path", "occurrence"], 7).select("query_id", "status", "no", "path", "occurrence", F.col("next_cursor").isNotNull().alias("more"))


register(
    "e15_bound_cursors",
    _bound,
    """WITH m AS (SELECT n_nationkey::INT AS query_id, path, occurrence, row_number() OVER (PARTITION BY n_nationkey ORDER BY path, occurrence) AS k, count(*) OVER (PARTITION BY n_nationkey) AS n
  FROM {nation} JOIN {nodes} ON language = (['go', 'java', 'rust', 'python'])[CAST(n_nationkey % 4 + 1 AS INT)] WHERE line % 5 = 0)
SELECT query_id, 'ok' AS status, CAST(k - 7 AS INT) AS no, path, occurrence, k = 14 AND n > 14 AS more FROM m WHERE query_id % 3 = 0 AND k BETWEEN 8 AND 14
UNION ALL SELECT DISTINCT query_id, CASE query_id % 3 WHEN 1 THEN 'changed' ELSE 'invalid' END, CAST(NULL AS INT), NULL, NULL, false FROM m WHERE n > 7 AND query_id % 3 > 0""",
)
register("t5_trailing", lambda x: ev.trailing_count(x.events, "user_id", "ts", 24).select("event_id", "trailing"), "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS trailing FROM {events}")
register("d6_ignored", lambda x: x.files.select("path", ev.ignored(F.col("path"), ["brand#1*/", "!src/brand#12/", "*.pb.go", "!**/large_*.pb.go", "src/brand#2/test_*"]).alias("ignored")), """SELECT path, (regexp_matches(lower(path), '^src/brand#1[^/]*/') AND NOT starts_with(lower(path), 'src/brand#12/')) OR (lower(path) LIKE '%.pb.go' AND NOT regexp_matches(lower(path), '/large_[^/]*\\.pb\\.go$')) OR starts_with(lower(path), 'src/brand#2/test_') AS ignored FROM {files}""")
_relations = lambda x: x.components.filter("NOT is_root").select("snapshot_id", F.lit("root").alias("from_element"), F.col("element_id").alias("to_element"))
register("p9_touching", lambda x: ev.touching(_relations(x), x.components.filter("status = 'conflict'").select("snapshot_id", F.col("element_id").alias("element")).unionByName(x.components.filter("status = 'unlicensed' AND is_root").select("snapshot_id", F.lit("root").alias("element")))).groupBy("snapshot_id").agg(F.count("*").alias("n")), """WITH r AS (SELECT snapshot_id, element_id FROM {components} WHERE NOT is_root) SELECT snapshot_id, count(*) AS n FROM (SELECT snapshot_id FROM r JOIN (SELECT DISTINCT snapshot_id, element_id FROM {components} WHERE status = 'conflict') c USING (snapshot_id, element_id)
UNION ALL SELECT snapshot_id FROM r WHERE snapshot_id IN (SELECT snapshot_id FROM {components} WHERE status = 'unlicensed' AND is_root)) q GROUP BY snapshot_id""")
