"""Indexed code search: postings of trigrams on disk, the trigrams that a regular expression needs, and few texts verified."""

from __future__ import annotations

import re
import re._parser as sre  # type: ignore[import-not-found]
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import durable
from .search import REQUESTS, bounded, parse_requests

#: Folders of postings (by trigram) and of files (by id).
BUCKETS = 64
#: Trigrams of a literal that are looked up, the rarest first. Fewer only let more files through to verification.
PROBES = 4
#: Candidate files whose folders are named to the scan; beyond so many, files are joined.
NAMED = 2_000


class Index(NamedTuple):
    """files: bucket, file_id, repository, path, text; postings: bucket, gram, file_id; frequencies: gram, files."""

    files: DataFrame
    postings: DataFrame
    frequencies: DataFrame


def _fold(text: str) -> str:
    """A-Z in lower case and nothing else, so that every kind of case folding agrees with it on ASCII."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def trigrams(text: str) -> np.ndarray:
    """The different runs of three code points of the folded text, 21 bits each in one number."""
    codes = np.frombuffer(_fold(text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]) if len(codes) > 2 else np.zeros(0, dtype=np.int64)


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(corpus: DataFrame, folder: str, most: int = 2_097_152) -> None:
    """Writes the index of a corpus (repository, path, text) below a folder that all executors share.

    Texts over `most` bytes are left out. A text is read once; its different trigrams are rows, sorted by trigram inside
    folders by hash of the trigram, so that a lookup reads few row groups of few folders.
    """
    own = corpus.filter(F.octet_length("text") <= most).select("repository", "path", "text").withColumn("file_id", F.xxhash64("repository", "path"))
    own.withColumn("bucket", F.pmod("file_id", F.lit(BUCKETS)).cast("int")).repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(16))).sortWithinPartitions("bucket", "file_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/files")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                ids, texts = (c.to_pylist() for c in b.slice(lo, 200).columns)
                lists = [trigrams(t or "") for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.repeat(np.array(ids, dtype=np.int64), [len(x) for x in lists]))], names=["gram", "file_id"])

    rows = own.select("file_id", "text").mapInArrow(grams, "gram long, file_id long").withColumn("bucket", _bucket(F.col("gram")))
    rows.repartition("bucket", F.pmod("file_id", F.lit(16))).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    read_index(own.sparkSession, folder).postings.groupBy("gram").agg(F.count("*").alias("files")).write.mode("overwrite").parquet(f"{folder}/frequencies")


def read_index(spark: SparkSession, folder: str) -> Index:
    files = spark.read.schema("file_id long, repository string, path string, text string, bucket int").parquet(f"{folder}/files")
    postings = spark.read.schema("gram long, file_id long, bucket int").parquet(f"{folder}/postings")
    return Index(files, postings, spark.read.schema("gram long, files long").parquet(f"{folder}/frequencies") if _there(spark, f"{folder}/frequencies") else spark.createDataFrame([], "gram long, files long"))


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def needs(pattern: str) -> list[list[str]]:
    """What every text that the regular expression fits has: of each list at least one string. Empty where nothing is sure.

    Literals in a row are one string; a group that must occur counts, an alternative counts if each of its branches needs something,
    and whatever may be absent or varies ends a string. A pattern that can't be read here needs nothing.
    """
    try:
        tree = sre.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return []
    if tree.state.flags & (re.VERBOSE | re.IGNORECASE):
        return []
    return _needs(tree)


def _needs(tree: sre.SubPattern) -> list[list[str]]:
    out: list[list[str]] = []
    run: list[str] = []

    def close() -> None:
        if run:
            out.append(["".join(run)])
            run.clear()

    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            run.append(chr(value))
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):  # no width
            continue
        elif name == "SUBPATTERN" and not value[1] and not value[2] and all(str(o) == "LITERAL" for o, _ in value[3]):
            run += [chr(v) for _, v in value[3]]
        else:
            close()
            if name == "SUBPATTERN" and not value[1] and not value[2]:
                out += _needs(value[3])
            elif name == "ATOMIC_GROUP":
                out += _needs(value)
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                out += _needs(value[2])
            elif name == "BRANCH":
                # of each branch the list whose shortest string is longest
                each = [max(_needs(b), key=lambda c: min(map(len, c)), default=[]) for b in value[1]]
                if all(each):
                    out.append([s for c in each for s in c])
    close()
    return out


def _plan(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(query_id, clause, option, gram) of requests; a clause of which some option has no trigram is left out."""
    for df in rows:
        out = []
        for q, terms, regex, case in zip(df["query_id"], df["terms"], df["regex"], df["case"], strict=True):
            clauses = [c for t in terms for c in (needs(t) if regex else [[t]])]
            for no, options in enumerate(clauses):
                # beyond ASCII, other kinds of folding may differ: such letters are only sure where case counts
                found = [np.unique(np.concatenate([trigrams(s) for s in ([o] if case else re.findall(r"[\x00-\x7F]+", o))] or [np.zeros(0, dtype=np.int64)])) for o in options]
                if found and all(len(g) for g in found):
                    out += [(q, no, at, int(g)) for at, grams in enumerate(found) for g in grams]
        yield pd.DataFrame(out, columns=["query_id", "clause", "option", "gram"])


def candidates(index: Index, asked: DataFrame) -> DataFrame:
    """(query_id, file_id) of files that have the trigrams that each request needs. asked: query_id, terms, regex, case; durable and bounded.

    The rarest PROBES trigrams of each literal are looked up in their folders; a file counts for a literal if it has all of them, for a
    clause if for one of its literals, for a request if for all its clauses. Requests that need nothing take every file.
    """
    wanted = durable(asked.mapInPandas(_plan, "query_id int, clause int, option int, gram long"))
    known = wanted.join(index.frequencies, "gram", "left").select("query_id", "clause", "option", "gram", F.coalesce("files", F.lit(0).cast("long")).alias("files"))
    by = known.groupBy("query_id", "clause", "option").agg(F.slice(F.array_sort(F.collect_list(F.struct("files", "gram"))), 1, PROBES).alias("probes"))
    probes = durable(by.select("query_id", "clause", "option", F.size("probes").alias("n"), F.explode("probes").alias("p")).select("query_id", "clause", "option", "n", "p.gram", _bucket(F.col("p.gram")).alias("bucket")))
    folders = [r["bucket"] for r in probes.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    held = index.postings.filter(F.col("bucket").isin(folders)).join(F.broadcast(probes.drop("bucket")), "gram")
    options = held.groupBy("query_id", "clause", "option", "file_id").agg(F.count("*").alias("had"), F.first("n").alias("n")).filter("had = n")
    met = options.select("query_id", "clause", "file_id").distinct().groupBy("query_id", "file_id").count()
    clauses = probes.groupBy("query_id").agg(F.countDistinct("clause").alias("clauses"))
    found = met.join(F.broadcast(clauses), "query_id").filter("count = clauses").select("query_id", "file_id")
    free = asked.select("query_id").join(clauses, "query_id", "left_anti")
    return found.unionByName(index.files.select("file_id").crossJoin(F.broadcast(free)).select("query_id", "file_id"))


def fits(line: Column, terms: Column, regex: Column, case: Column) -> Column:
    """Whether a line has all terms of a request."""
    pattern = lambda t: F.when(case, t).otherwise(F.concat(F.lit("(?i)"), t))
    plain = lambda t: F.when(case, F.contains(line, t)).otherwise(F.contains(F.lower(line), F.lower(t)))
    return F.forall(terms, lambda t: F.when(regex, F.regexp_like(line, pattern(t))).otherwise(plain(t)))


def search(index: Index, req: DataFrame, context: int = 3, limit: int = 100) -> DataFrame:
    """(query_id, repository, path, line_no, preview, no, truncated): search for a table of requests over the index.

    req: query_id int, text (read by parse_requests) and regex boolean; at most REQUESTS; those with a problem find nothing. A line
    matches if it has all terms; preview has up to 20 lines of context on both sides. The first `limit` matches of a
    request by repository, path and line stay, truncated where there were more. What is found equals a scan of all texts.
    """
    context = min(context, 20)
    if req.limit(REQUESTS + 1).count() > REQUESTS:
        raise ValueError(f"at most {REQUESTS} requests at a time")
    asked = parse_requests(req).filter("problem IS NULL AND size(terms) > 0").join(req.select("query_id", F.coalesce("regex", F.lit(False)).alias("regex")), "query_id")
    asked = durable(asked.select(F.col("query_id").cast("int").alias("query_id"), "terms", "files", "case", "regex"))
    found = durable(candidates(index, asked))
    files = index.files
    few = found.select("file_id").distinct().limit(NAMED + 1).collect()  # ids of at most NAMED files, or none is named
    if len(few) <= NAMED:
        ids = [r["file_id"] for r in few]
        files = files.filter(F.col("bucket").isin(sorted({i % BUCKETS for i in ids})) & F.col("file_id").isin(ids))
    each = found.join(F.broadcast(asked), "query_id").groupBy("file_id").agg(F.collect_list(F.struct("query_id", "terms", "files", "case", "regex")).alias("asks"))
    texts = files.drop("bucket").join(each, "file_id").select("repository", "path", F.split("text", "\n", -1).alias("lines"), F.explode("asks").alias("r"))
    texts = texts.filter(F.forall("r.files", lambda f: F.regexp_like(F.col("path"), f)))
    numbered = F.filter(F.transform("lines", lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line"))), lambda x: fits(x["line"], F.col("r.terms"), F.col("r.regex"), F.col("r.case")))
    first = lambda n: F.greatest(n - context, F.lit(1))
    shown = F.transform("hits", lambda x: F.struct(x["line_no"].alias("line_no"), F.array_join(F.slice("lines", first(x["line_no"]), x["line_no"] + 1 + context - first(x["line_no"])), "\n").alias("preview")))
    hits = texts.withColumn("hits", numbered).filter(F.size("hits") > 0).select("r.query_id", "repository", "path", F.explode(shown).alias("h")).select("query_id", "repository", "path", "h.line_no", "h.preview")
    return bounded(hits, ["repository", "path", "line_no"], limit)
