"""Assessments that are kept up to date as evidence arrives: only coordinates with new evidence are assessed, only changes are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.review import assess

#: Folders of evidence and assessments by hash of the coordinate: a batch reads those of its own coordinates.
SLOTS = 64
_OUTCOME = ("status", "expression", "detail", "fingerprint")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """What batches have written so far, with the columns batch and slot; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}/batch=*")


def _latest(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the last batch of each key; rows that repeat in it are kept."""
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("batch")))).filter("_r = 1").drop("_r")


def reassessed(evidence: DataFrame, occurrences: DataFrame, folder: str, by: list[str]) -> DataStreamWriter:
    """A stream of evidence rows (id, source, license_raw and by) that maintains the assessments of occurrences (by and other columns).

    Each batch is added to the evidence below folder; the coordinates that it names are assessed from all their evidence, by the rule of
    `assess`; those whose outcome differs from the last known one are written as a new version, with the outcome before, and once for each
    occurrence, which is what has to be evaluated again. A batch that is run again after a failure writes the same folders
    anew and reads only what earlier batches wrote, so that it changes nothing twice.
    """
    key = F.xxhash64(*by)

    def step(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        slotted = batch.withColumn("slot", F.pmod(key, F.lit(SLOTS)).cast("int"))
        slotted.write.mode("overwrite").partitionBy("slot").parquet(f"{folder}/evidence/batch={no}")
        if batch.isEmpty():
            return
        own = spark.read.parquet(f"{folder}/evidence/batch={no}").select(*by, "slot").distinct()
        slots = [r["slot"] for r in own.select("slot").distinct().collect()]  # at most SLOTS numbers
        known = _table(spark, folder, "evidence").filter(F.col("slot").isin(slots) & (F.col("batch") <= no))  # type: ignore[union-attr]
        new = assess(known.join(own.select(*by), by, "left_semi").drop("slot", "batch"), by)
        before = _table(spark, folder, "assessments")
        if before is None:
            old = new.select(*by, *[F.col(c).alias(f"old_{c}") for c in _OUTCOME]).limit(0)
        else:
            old = _latest(before.filter(F.col("slot").isin(slots) & (F.col("batch") < no)), by).select(*by, *[F.col(c).alias(f"old_{c}") for c in _OUTCOME])
        same = F.lit(True)
        for c in _OUTCOME:
            same &= F.col(c).eqNullSafe(F.col(f"old_{c}"))
        changed = new.join(old, by, "left").filter(F.col("old_fingerprint").isNull() | ~same).select(*by, *_OUTCOME, "old_status", "old_expression", F.pmod(key, F.lit(SLOTS)).cast("int").alias("slot"))
        changed.write.mode("overwrite").partitionBy("slot").parquet(f"{folder}/assessments/batch={no}")
        told = spark.read.schema(changed.schema).parquet(f"{folder}/assessments/batch={no}").drop("slot")
        occurrences.join(told, by).write.mode("overwrite").parquet(f"{folder}/occurrences/batch={no}")

    return evidence.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(step)


def run(writer: DataStreamWriter) -> None:
    writer.start().awaitTermination()


def assessments(spark: SparkSession, folder: str, by: list[str]) -> DataFrame:
    """The outcome of each coordinate as of now."""
    return _latest(_table(spark, folder, "assessments"), by).select(*by, *_OUTCOME)  # type: ignore[arg-type]


def occurrences(spark: SparkSession, folder: str, by: tuple[str, ...] = ("snapshot_id", "element_id")) -> DataFrame:
    """The outcome of each occurrence as of now, by its id."""
    return _latest(_table(spark, folder, "occurrences"), list(by)).drop("batch")  # type: ignore[arg-type]


def to_evaluate(spark: SparkSession, folder: str, since: int) -> DataFrame:
    """Occurrences whose outcome has changed after batch `since`: what policies have to be evaluated for again."""
    return _table(spark, folder, "occurrences").filter(F.col("batch") > since)  # type: ignore[union-attr]
