"""Registered queries over generations, packages and symbols across repositories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as lc
from ..operators import review as r
from .bindings import Facts
from .graph_queries import register

_GEN = "SELECT id, repository_id, CASE WHEN stream_key < '3' THEN 'external' ELSE 'scip' END AS source, outcome = 'published' AS at_indexed_commit, digest, stream_key AS producer, collected_at AS retired_at FROM {snapshots}"


def _gen(x: Facts):
    return x.spark.sql(_GEN, snapshots=x.snapshots)


register("v2_active_generation", lambda x: lc.active_generation(_gen(x)), f"WITH g AS ({_GEN}) SELECT repository_id, id, source FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY CASE WHEN source = 'external' THEN 0 ELSE 1 END, id DESC) AS r FROM g WHERE at_indexed_commit) q WHERE r = 1")
register("v6_freshness", lambda x: lc.freshness(x.files.filter("language <> 'rust'").select("path", F.col("size").cast("string").alias("hash")), x.files.filter("language <> 'java'").select("path", F.when(F.col("node_count") > 1, (F.col("size") + F.col("node_count") % 2).cast("string")).alias("hash"))), """WITH a AS (SELECT path, CAST(size AS STRING) AS was FROM {files} WHERE language <> 'rust'), b AS (SELECT path, CASE WHEN node_count > 1 THEN CAST(size + node_count % 2 AS STRING) END AS now, 1 AS one FROM {files} WHERE language <> 'java')
SELECT path, change FROM (SELECT path, CASE WHEN one IS NULL THEN 'not_in_commit' WHEN was IS NULL THEN 'not_indexed' WHEN now IS NULL THEN 'unverifiable' WHEN was <> now THEN 'modified' END AS change FROM a FULL JOIN b USING (path)) q WHERE change IS NOT NULL""")
register("v7_prunable", lambda x: lc.prunable(_gen(x), "2000-01-01 00:00:00", 30), f"WITH g AS ({_GEN}) SELECT id, row_number() OVER (PARTITION BY repository_id ORDER BY retired_at, id) AS no, repository_id FROM g WHERE retired_at < TIMESTAMP '2000-01-01' - INTERVAL 30 DAY")
register("s3_publish_outcome", lambda x: lc.publish_outcome(_gen(x), lc_active(x)), f"WITH g AS ({_GEN}), a AS (SELECT repository_id, arg_min(digest, id) AS old, arg_min(producer, id) AS op FROM g GROUP BY 1) SELECT id, CASE WHEN old IS NULL THEN 'first' WHEN old = digest THEN 'unchanged' WHEN op <> producer THEN 'producer_changed' ELSE 'replaced' END AS outcome FROM g LEFT JOIN a USING (repository_id)")


def lc_active(x: Facts):
    return _gen(x).groupBy("repository_id").agg(F.min_by("digest", "id").alias("digest"), F.min_by("producer", "id").alias("producer"))


