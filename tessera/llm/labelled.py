"""A bounded sample of labelled rows outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, held_out

#: Labelled rows that a model is fitted on at most: those with the smallest hash of their id.
SAMPLE_ROWS = 12_000


def sample(labels: DataFrame, target: str, id_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(_id, _y) of at most `rows` labelled ids whose crc32 leaves a remainder modulo 5; a durable table.

    An id with several labels has their maximum. Null ids and null labels are left out.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(target).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL")
    train = known.filter(~held_out("_id")).groupBy("_id").agg(F.max("_y").alias("_y"))
    return durable(train.orderBy(F.xxhash64("_id"), "_id").limit(rows))


def sampled_docs(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, _y) of the sampled rows; the sample's bound allows the broadcast."""
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return src.join(F.broadcast(picked), "_id")
