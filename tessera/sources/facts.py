"""Graph facts and texts as stored tables: generations written and read by partition, checked before they are published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import RELATIONS

TABLES = ("nodes", "edges", "files", "unresolved", "diagnostics")
#: Bytes from which a file is not taken into the text corpus.
TEXT_LIMIT = 2_097_152
_KEYS = ("repository_id", "upload_id")
SEVERITIES = ("error", "warning", "information", "hint")


def violations(nodes: DataFrame, edges: DataFrame, files: DataFrame, unresolved: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """(repository_id, upload_id, rule, subject): what forbids publishing a generation.

    Duplicate occurrences, unknown relation kinds, ends of edges and unresolved references that are no nodes, confidences
    outside 0 to 1, ends of a range before its start, content hashes that aren't 64 hexadecimal digits, paths without a file,
    unknown severities. Columns that a table lacks aren't checked.
    """
    key = list(_KEYS)
    rule = lambda df, name, subject="occurrence": df.select(*key, F.lit(name).alias("rule"), F.col(subject).cast("string").alias("subject"))
    known = nodes.select(*key, "occurrence").distinct()
    out = [rule(t.groupBy(*key, "occurrence").count().filter("count > 1"), f"duplicate {n}") for n, t in (("node", nodes), ("edge", edges))]
    for end in ("source", "target"):
        out.append(rule(edges.join(known.withColumnRenamed("occurrence", end), [*key, end], "left_anti"), f"dangling {end}"))
    out.append(rule(unresolved.join(known.withColumnRenamed("occurrence", "source"), [*key, "source"], "left_anti"), "dangling reference"))
    out.append(rule(edges.filter(~F.col("kind").isin(*RELATIONS)), "unknown kind"))
    out.append(rule(edges.filter("confidence < 0 OR confidence > 1"), "bad confidence"))
    if {"line", "end_line"} <= set(nodes.columns):
        out.append(rule(nodes.filter("end_line < line"), "bad location"))
    if "content_hash" in files.columns:
        out.append(rule(files.filter(~F.coalesce(F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))), "bad file hash", "path"))
    out.append(rule(nodes.filter("path IS NOT NULL").join(files.select(*key, "path").distinct(), [*key, "path"], "left_anti"), "unknown path"))
    if diagnostics is not None:
        out.append(rule(diagnostics.filter(~F.col("severity").isin(*SEVERITIES)), "unknown severity"))
    all_ = out[0]
    for o in out[1:]:
        all_ = all_.unionByName(o)
    return all_


def publish(folder: str, tables: dict[str, DataFrame], bad: DataFrame) -> None:
    """Append the generations without violations to folder, partitioned by repository and upload.

    tables: name → rows with repository_id and upload_id. Only generations that none of bad names are written.
    """
    stop = bad.select(*_KEYS).distinct()
    for name, rows in tables.items():
        rows.join(stop, list(_KEYS), "left_anti").repartition(*_KEYS).write.mode("append").partitionBy(*_KEYS).parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str, wanted: DataFrame | None = None) -> DataFrame:
    """One fact table of a folder; with wanted (repository_id, upload_id) of those generations, whose partitions alone are read."""
    rows = spark.read.parquet(f"{folder}/{name}")
    return rows if wanted is None else rows.join(F.broadcast(wanted.select(*_KEYS).distinct()), list(_KEYS), "left_semi")


def text_corpus(rows: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
    """Files whose text may be searched: repository, commit, path, text of at most `limit` bytes."""
    return rows.filter(F.octet_length("text") <= limit).select("repository", "commit", "path", "text")


def import_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of an index database as facts: JSON arrays become arrays, flags booleans, lines and columns zero-based points."""
    flag = lambda c: F.when(F.col(c).isNotNull(), F.col(c) != 0).alias(c)
    lists = lambda c: F.from_json(c, "array<string>").alias(c)
    point = lambda a, b: F.struct(F.when(F.col(a) > 0, F.col(a) - 1).alias("line"), F.col(b).alias("character"))
    return rows.select(
        F.col("id").alias("occurrence"), "kind", "name", "qualified_name", F.col("file_path").alias("path"), "language", "signature", "visibility", flag("is_exported"), flag("is_async"), flag("is_static"), flag("is_abstract"),
        lists("decorators"), lists("type_parameters"), "return_type", F.struct(point("start_line", "start_column").alias("start"), point("end_line", "end_column").alias("end")).alias("location"),
    )


def import_edges(rows: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """(edges, rejected) of an index database.

    confidence and the reason come from the metadata JSON. An edge's occurrence is a hash of the scope and its facts; equal
    facts are told apart by their ordinal in id order. Edges of unknown kinds are rejected: (kind, n).
    """
    meta = F.from_json("metadata", "confidence double, resolvedBy string")
    e = rows.withColumn("m", meta).filter(F.col("kind").isin(*RELATIONS))
    facts = F.sha2(F.to_json(F.struct(F.lit(scope).alias("scope"), "source", "target", "kind", "line", "col", "metadata", "provenance")), 256)
    e = e.withColumn("h", facts).withColumn("no", F.row_number().over(Window.partitionBy("h").orderBy("id")) - 1)
    out = e.select(
        F.concat("h", F.lit("-"), F.col("no").cast("string")).alias("occurrence"), F.col("id").cast("string").alias("source_id"), "source", "target", "kind", F.col("m.confidence").alias("confidence"), F.col("m.resolvedBy").alias("reason"), "provenance",
        F.when(F.col("line").isNotNull(), F.struct(F.when(F.col("line") > 0, F.col("line") - 1).alias("line"), F.col("col").alias("character"))).alias("start"),
    )
    return out, rows.filter(~F.col("kind").isin(*RELATIONS)).groupBy("kind").agg(F.count("*").alias("n"))


def import_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(category, kind, n): what an import brought."""
    return nodes.select(F.lit("node").alias("category"), "kind").unionByName(edges.select(F.lit("edge").alias("category"), "kind")).groupBy("category", "kind").agg(F.count("*").alias("n"))
