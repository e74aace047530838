"""The expressions of the secret scan hold each pattern once, so that no match is made again for each element of an array."""

from pyspark.sql import functions as F

from tessera.llm import secret_scan


def test_patterns_are_matched_once(spark):
    text = lambda c: c._jc.toString().lower()
    assert text(secret_scan._spans(F.col("t"), secret_scan.CANDIDATE)).count("regexp_extract_all") == 1
    assert text(secret_scan._spans(F.col("t"), secret_scan.ASSIGN, 2, 8)).count("regexp_extract_all") == 2
    assert text(secret_scan.surprise(F.col("t"))).count("rlike") == len(secret_scan.ENCODINGS) - 1


def test_many_matches_in_a_text(spark):
    """20,000 candidates in one text: places are those that a search by hand finds."""
    import re

    words = [f"token{'x' * (i % 7)}{i:012}" for i in range(20_000)]
    docs = spark.createDataFrame([("é " + " ü ".join(words),)], "t string")
    (row,) = docs.select(secret_scan._spans(F.col("t"), secret_scan.CANDIDATE).alias("s")).collect()
    assert [(x.s, x.e, x.m) for x in row.s] == [(m.start(), m.end(), m[0]) for m in re.finditer(secret_scan.CANDIDATE, docs.first().t)]
