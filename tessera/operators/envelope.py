"""What every bounded answer says of itself: its status, whether it is partial, and the boundaries that it met.

Operators return their rows; these functions return the boundaries beside them, as (query_id, reason, depth, n).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Why an answer may be incomplete.
REASONS = ("depth_limit", "fanout_limit", "traversal_limit", "node_limit", "edge_limit", "page_limit", "category_limit", "row_limit", "candidate_limit", "graph_missing", "graph_not_ready")


def _boundary(rows: DataFrame, reason: str, depth: Column | None = None) -> DataFrame:
    return rows.select("query_id", F.lit(reason).alias("reason"), (F.lit(None).cast("int") if depth is None else depth.cast("int")).alias("depth"), F.col("n").cast("long").alias("n"))


def limited(rows: DataFrame, order: list[str | Column], limit: int, reason: str = "row_limit", within: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(the first `limit` rows of each request, or of each group within it; how many rows each request lost)."""
    w = Window.partitionBy("query_id", *(within or [])).orderBy(*order)
    ranked = rows.withColumn("_no", F.row_number().over(w))
    lost = ranked.filter(F.col("_no") > limit).groupBy("query_id").agg(F.count("*").alias("n"))
    return ranked.filter(F.col("_no") <= limit).drop("_no"), _boundary(lost, reason)


def depth_limit(step: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """Requests whose traversal ended at the depth although it had somewhere to go: n is the nodes not gone to."""
    edge = reached.filter(F.col("depth") == depth).select("query_id", F.col("node").alias("here"))
    beyond = edge.join(step.select("here", F.col("there").alias("node")).distinct(), "here").select("query_id", "node").distinct().join(reached.select("query_id", "node"), ["query_id", "node"], "left_anti")
    return _boundary(beyond.groupBy("query_id").agg(F.count("*").alias("n")), "depth_limit", F.lit(depth))


def fanout_limit(step: DataFrame, reached: DataFrame, fanout: int) -> DataFrame:
    """Requests that came through a node with more steps than `fanout`; n is the number of such nodes."""
    wide = step.groupBy(F.col("here").alias("node")).agg(F.count("*").alias("m")).filter(F.col("m") > fanout)
    return _boundary(reached.join(wide, "node").groupBy("query_id").agg(F.count("*").alias("n")), "fanout_limit")


def answers(requests: DataFrame, results: DataFrame, boundaries: list[DataFrame], candidates: DataFrame | None = None) -> DataFrame:
    """(query_id, status, partial, reasons): not_found without a result, ambiguous with several candidates, else ok.

    candidates: query_id, one row for each node that the request's root may be.
    """
    found = results.groupBy("query_id").agg(F.count("*").alias("rows"))
    out = requests.select("query_id").distinct().join(found, "query_id", "left")
    if candidates is not None:
        out = out.join(candidates.groupBy("query_id").agg(F.count("*").alias("candidates")), "query_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    else:
        out = out.withColumn("candidates", F.when(F.col("rows") > 0, 1).otherwise(0))
    told = boundaries[0]
    for b in boundaries[1:]:
        told = told.unionByName(b)
    why = told.groupBy("query_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    status = F.when(F.col("candidates") == 0, "not_found").when(F.col("candidates") > 1, "ambiguous").otherwise("ok")
    return out.join(why, "query_id", "left").select("query_id", status.alias("status"), F.col("reasons").isNotNull().alias("partial"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))
