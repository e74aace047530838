"""Incremental operators on append-only sources; each equals a batch form over the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..shipping import shared_dir


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stream of a Parquet table's files, present and to come."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # a file or a folder of files: a pattern that matches the one name
    rows = spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")
    # watermarks are kept on instants
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def drain(stream: DataFrame, mode: str = "append", end: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its result, kept in the shared folder.

    end: the folder of a `closed` stream, which is closed then, so that what it holds back comes out too.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/{'last' if mode == 'complete' else f'batch={no}'}")

    def run() -> None:
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    run()
    if end is not None:
        close(spark, end)
        run()
    return spark.read.schema(stream.schema).parquet(f"{at}/out/last" if mode == "complete" else f"{at}/out/batch=*")


def first_deliveries(events: DataFrame, key: str = "delivery_id", at: str = "ts", keep: str = "30 days") -> DataFrame:
    """The first event of each id; repeats within the retention are dropped. Ids older than the watermark are forgotten."""
    return events.withWatermark(at, keep).dropDuplicatesWithinWatermark([key])


def sliding_quota(events: DataFrame, key: str, at: str = "ts", width: str = "24 hours", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width, slide), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def pointers(events: DataFrame, key: str, at: str, order: str, good: Column | None = None) -> DataFrame:
    """Latest row, last success, last outcome and number of rows per key, for complete mode. good: whether a row is a success."""
    out = [F.max(at).alias("last_at"), F.max(order).alias("last_id"), F.count("*").alias("n")]
    if good is not None:
        out += [F.max(F.when(good, F.col(at))).alias("last_success_at"), F.max_by(good, order).alias("last_good")]
    return events.groupBy(key).agg(*out)


def imports_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first accepted import of each (key, digest): a repeat returns the earlier one, so it isn't in the result. events: key, digest, ts, accepted."""
    return events.filter("accepted").withWatermark("ts", late).dropDuplicates(["key", "digest"])


class _InOrder(StatefulProcessor):
    """Rows of a key taken in order of time and id, however they arrive: they are held until the watermark has passed them.

    fold makes (outcome, new state) of the state, a text or None, and a row's value. A timer is set for each row's time; when one
    expires, all held rows that no earlier row can precede any more are taken. Rows without an id only move the watermark.
    """

    def __init__(self, fold: Callable[[str | None, str | None], tuple[str, str | None]]):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, id long, value string")
        self.now = handle.getValueState("now", "value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for df in rows:
            df = df[df["id"].notna()]
            if len(df):
                self.held.appendList([(int(a), int(i), None if pd.isna(v) else str(v)) for a, i, v in zip(df["at"], df["id"], df["value"], strict=True)])
                for at in (df["at"] // 1000).unique():
                    self.handle.registerTimer(int(at) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sure = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.held.get())
        due = [r for r in rows if r[0] <= sure]
        if not due:
            return
        if len(due) < len(rows):
            self.held.put(rows[len(due) :])
        else:
            self.held.clear()
        now = self.now.get()[0] if self.now.exists() else None
        outcomes = []
        for _, _, value in due:
            outcome, now = self.fold(now, value)
            outcomes.append(outcome)
        self.now.update((now,))
        yield pd.DataFrame({"key": [key[0]] * len(due), "id": [r[1] for r in due], "value": [r[2] for r in due], "outcome": outcomes})

    def close(self) -> None:
        pass


def in_order(events: DataFrame, fold: Callable[[str | None, str | None], tuple[str, str | None]], late: str = "1 hour") -> DataFrame:
    """(key, id, value, outcome): fold over the rows of each key in order of ts and id. events: key, id long, ts, value string.

    Rows may arrive in any order and in any number of batches, at most `late` behind the newest; later ones are dropped. What is
    held for a key is what came within that time. Needs the RocksDB state store (`drain` sets it).
    """
    kind = events.schema["key"].dataType.simpleString()
    rows = events.withWatermark("ts", late).select("key", "id", "ts", F.unix_micros("ts").alias("at"), "value")
    return rows.groupBy("key").transformWithStateInPandas(_InOrder(fold), f"key {kind}, id long, value string, outcome string", "append", "EventTime")


def _target(now: str | None, value: str | None) -> tuple[str, str | None]:
    return ("ended", None) if value is None else ("same" if value == now else "queued", value)


def coalesced_targets(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """queued where a key's target differs from the one that is pending, else same: (key, id, target, outcome). events: key, id, ts, target.

    A null target says that the pending work has ended; after it every target is queued. Order is that of `in_order`.
    """
    return in_order(events.select("key", "id", "ts", F.col("target").alias("value")), _target, late).withColumnRenamed("value", "target")


def _publication(now: str | None, value: str | None) -> tuple[str, str | None]:
    return ("failed", now) if value is None else ("unchanged" if value == now else "published", value)


def publications(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """published where a digest differs from the key's current one, else unchanged; failed without a digest, which moves nothing.

    events: key, id, ts, digest (text; null for a failed arrival). Order is that of `in_order`.
    """
    return in_order(events.select("key", "id", "ts", F.col("digest").cast("string").alias("value")), _publication, late).drop("value")


def closed(events: DataFrame, folder: str) -> DataFrame:
    """A stream with an end: once `close` has written to the folder, its watermark passes everything. events: ts, id and other nullable columns."""
    end = events.sparkSession.createDataFrame([], events.schema)
    end.write.mode("overwrite").parquet(folder)
    return events.unionByName(events.sparkSession.readStream.schema(events.schema).parquet(folder))


def close(spark: SparkSession, folder: str) -> None:
    """A row without anything but a time beyond all others."""
    schema = spark.read.parquet(folder).schema
    far = spark.range(1).select(*[(F.timestamp_micros(F.lit(_END)) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    far.write.mode("append").parquet(folder)


#: The first of January 2200, in microseconds: pandas has no room for much later times.
_END = 7258118400000000
