"""Streams against their batch forms, with rows in any order over many batches."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.review import assess
from tessera.streaming import maintain, streams

EVENTS = "key long, id long, ts timestamp, value string"


def arrive(spark, rows, folder, files, schema=EVENTS):
    """Rows dealt into files in the order given; a stream that reads one file a batch."""
    step = -(-len(rows) // files)
    for no in range(files):
        spark.createDataFrame(rows[no * step : no * step + step], schema).coalesce(1).write.parquet(f"{folder}/part={no:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def events(n, seed):
    rng = random.Random(seed)
    return [(rng.randrange(5), i, i // 3 * 60, rng.choice(["a", "a", "b", None])) for i in range(n)]


@pytest.mark.parametrize(("late", "shuffle"), [("1 hour", 30), ("30 days", None)])
def test_order_does_not_depend_on_arrival(spark, tmp_path, late, shuffle):
    rows = events(400, 3)
    rng = random.Random(4)
    # late by at most `shuffle` rows, or in any order at all
    order = sorted(range(len(rows)), key=lambda i: i + rng.uniform(0, shuffle)) if shuffle else rng.sample(range(len(rows)), len(rows))
    timed = [(k, i, None, v) for k, i, _, v in (rows[o] for o in order)]
    df = [(k, i, rows[i][2], v) for k, i, _, v in timed]
    import datetime

    start = datetime.datetime(2024, 1, 1)
    df = [(k, i, start + datetime.timedelta(seconds=s), v) for k, i, s, v in df]
    for build, fold in ((lambda e: streams.coalesced_targets(e.withColumnRenamed("value", "target"), late), streams._target), (lambda e: streams.publications(e.withColumnRenamed("value", "digest"), late), streams._publication)):
        at = str(tmp_path / fold.__name__)
        stream = arrive(spark, df, f"{at}/in", 12)
        got = {r.id: r.outcome for r in streams.drain(build(streams.closed(stream, f"{at}/end")), end=f"{at}/end").collect()}
        now, want = {}, {}
        for k, i, _, v in rows:
            want[i], now[k] = fold(now.get(k), v)
        assert got == want


def test_what_is_not_final_is_held_back(spark, tmp_path):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    df = [(1, i, start + datetime.timedelta(minutes=i), "a") for i in range(120)]
    got = streams.drain(streams.publications(arrive(spark, df, f"{tmp_path}/in", 3).withColumnRenamed("value", "digest"))).collect()
    assert {r.id for r in got} == set(range(60))  # the last is at 119 minutes, the watermark an hour before


def test_reassessed_equals_a_full_run(spark, tmp_path):
    rng = random.Random(5)
    schema = "coordinate long, id long, source string, license_raw string"
    rows = [(rng.randrange(30), i, rng.choice(["registry_npm", "producer_declared", "producer_concluded"]), rng.choice(["MIT", "mit", "Apache-2.0", "none", "NOASSERTION", None, "MIT"])) for i in range(240)]
    where = spark.createDataFrame([(s, f"e{c}", c) for s in (1, 2) for c in range(0, 30, 2)], "snapshot_id long, element_id string, coordinate long")
    folder = str(tmp_path)
    maintain.run(maintain.reassessed(arrive(spark, rows, f"{folder}/in", 8, schema), where, folder, ["coordinate"]))
    columns = ["coordinate", *maintain._OUTCOME]
    want = assess(spark.createDataFrame(rows, schema), ["coordinate"]).select(*columns)
    assert sorted(map(tuple, maintain.assessments(spark, folder, ["coordinate"]).select(*columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    got = maintain.occurrences(spark, folder)
    assert got.count() == where.count() and got.join(want, columns, "left_anti").join(want, "coordinate").count() == got.filter(F.col("detail").isNull() | F.col("expression").isNull()).join(want, "coordinate").count()
    # versions are written only where something changed, each once a batch
    versions = maintain._table(spark, folder, "assessments")
    assert versions.groupBy("coordinate", "batch").count().filter("count > 1").isEmpty()
    again = versions.alias("a").join(versions.alias("b"), "coordinate").filter("a.batch < b.batch").groupBy("coordinate", F.col("b.batch").alias("batch")).agg(F.max_by("a.fingerprint", "a.batch").alias("before"), F.first("b.fingerprint").alias("now"))
    assert again.filter("before = now").isEmpty()
    # nothing new: nothing to evaluate
    last = versions.agg(F.max("batch")).first()[0]
    maintain.run(maintain.reassessed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*"), where, folder, ["coordinate"]))
    assert maintain.to_evaluate(spark, folder, last).isEmpty()
