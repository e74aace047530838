"""The corpus pipeline: toxic documents out, repeated lines out, one of each near-duplicate group, no benchmark text, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in the shared folder and read
again as the next one's docs. All stages but the last return the columns of documents, whatever further ones there are.
Null and empty texts, null ids and repeated rows stay unless a docstring says otherwise; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, decontam, line_dedup, ngram_join, toxicity
from tessera.llm.queries import table, tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Score from which a document is rejected as toxic.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under TOXIC; the machine is fitted on the labelled ones among docs."""
    common.ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = common.unused(docs, "toxicity")
    return toxicity.score(docs, model, name=name).filter(F.col(name) < TOXIC).drop(name)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur elsewhere; n_chars follows the text. A text may become empty, its row stays."""
    common.ship(spark)
    counts = common.unused(docs, "n_lines"), common.unused(docs, "n_dropped")
    kept = line_dedup.dedup_lines(docs, counts=counts).drop(*counts)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*common.columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id. Rows without an id stay."""
    common.ship(spark)
    classes = ngram_join.near_duplicates(docs)
    gone = common.durable(classes.filter("doc_id <> component_id").select("doc_id").distinct())
    return common.key_join(docs, gone, "doc_id", "left_anti").select(*common.columns(docs))


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Rows without an id are judged like others."""
    common.ship(spark)
    return decontam.without_hits(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document."""
    common.ship(spark)
    return bpe.bpe_round_trip(docs, *tokenizer(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_text),
    ("byte_bpe", encode),
]

#: Learned scores, SimHash links and byte-pair merges can't be expressed in SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for no, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{no}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
