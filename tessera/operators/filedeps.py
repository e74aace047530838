"""File dependencies: edges seen as references between the files of their ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import confident


def pairs(nodes: DataFrame, edges: DataFrame, least: float = 0.0) -> DataFrame:
    """(source_path, target_path, refs) over edges other than contains whose confidence is null or at least `least`."""
    at = nodes.filter("path IS NOT NULL").select("occurrence", "path")
    e = edges.filter((F.col("kind") != "contains") & confident(least)).select("source", "target")
    e = e.groupBy("source", "target").agg(F.count("*").alias("c"))  # parallel edges fold before they meet the nodes
    moved = e.join(at.toDF("source", "source_path"), "source").join(at.toDF("target", "target_path"), "target")
    return moved.filter("source_path <> target_path").groupBy("source_path", "target_path").agg(F.sum("c").alias("refs"))


def dependent_counts(deps: DataFrame) -> DataFrame:
    return deps.groupBy("target_path").agg(F.count("*").alias("dependents"))


def reach_counts(deps: DataFrame) -> DataFrame:
    return deps.groupBy("source_path").agg(F.count("*").alias("files"), F.sum("refs").alias("refs"))


def dependencies(deps: DataFrame) -> DataFrame:
    return deps.groupBy("source_path").agg(F.sort_array(F.collect_list("target_path")).alias("targets"))


def dependents(deps: DataFrame) -> DataFrame:
    return deps.groupBy("target_path").agg(F.sort_array(F.collect_list("source_path")).alias("sources"))
