"""Helpers shared by the corpus operators: durable checkpoints, checked broadcasts, folds, components."""

from __future__ import annotations

import gc
import os
import sys
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key table that may be broadcast: a few dozen bytes a row keeps it under 64 MB.
BROADCAST_ROWS = 500_000


def ship(spark: SparkSession) -> None:
    """Let Python workers started after this call import this package."""
    root = str(Path(__file__).resolve().parents[2])
    if root not in sys.path:
        sys.path.insert(0, root)
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; on a cluster that would be one machine's own, so it raises.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not told:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(told)
    return told.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the written copy, whose lineage is cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Lets go of what earlier rounds of a loop left: shuffle files and checkpoints that nothing refers to are removed when the driver
    collects its garbage, which a loop of small steps otherwise does too rarely."""
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: durable like a checkpoint, but compressed and read by column."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _TABLES[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more: what was made of them must be durable itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_TABLES.pop(df))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Paths of the tables that `written` made, as long as someone holds them.
_TABLES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever signs their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """name, with low lines behind it until no column of df is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def beside(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, text): each row of docs as one struct, so that its columns' names clash with nothing, and its text."""
    return docs.select(F.struct(*columns(docs)).alias("row"), F.col(text_col).alias("text"))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df, a durable table of narrow rows, has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def key_join(left: DataFrame, keys: DataFrame, on: list[str] | str, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join to a durable table of keys: broadcast when its counted size is under the bound, shuffled beyond it."""
    return left.join(F.broadcast(keys) if small_enough(keys, rows) else keys, on, how)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold whose labels no model reads: crc32 of the id as text leaves no remainder modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def components(nodes: DataFrame, edges: DataFrame, few: int | None = None) -> DataFrame:
    """(id, component): the smallest id reachable from each id of nodes over the undirected edges (a, b).

    Alternates large-star and small-star steps, each a partial aggregation and a join, until the edges no longer
    change. Nodes without edges are their own component. Neither edges nor components reach the driver. Up to `few`
    edges (FEW_EDGES if not given), a few megabytes, the steps run in one partition, where they need no shuffle.
    """
    e = durable(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    total = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    before = total(e)
    few = before["n"] <= (FEW_EDGES if few is None else few)
    turn = 0
    while before["n"]:
        turn += 1
        if turn % 4 == 0:
            tidy(nodes.sparkSession)
        e = e.coalesce(1) if few else e
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .filter("u <> v")
            .distinct()
        )
        e = durable(small)
        after = total(e)
        if after == before:
            break
        before = after
    own = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return nodes.select("id").distinct().join(own, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


#: So many edges at most are linked in one partition.
FEW_EDGES = 100_000


def linked(posts: DataFrame, members: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Column | None = None, rounds: int = 2, leads: int = 3, few: int = 200_000, share: float = 4, links: DataFrame | None = None) -> DataFrame:
    """(id, component) of all ids of members, linked where verify lets a pair (a, b) pass; sub-quadratic where ids are alike.

    links (a, b), if given, are edges between ids that are known already. posts (token, unit, and any columns that near compares with their namesakes ending in 2) says which units can hold
    linked ids: those that share a token. members (unit, id) says which ids a unit stands for; a unit bears the
    name of one of them. Both are durable. Every pair of ids of one unit, and every pair whose units share a token and
    pass near, is verified or lies in one component already (a unit that near doesn't let pass with itself has no links
    inside):

    1. ids are compared with their unit, and units with the smallest unit of each of their tokens (a star, not all pairs);
    2. as long as more pairs than `few`, and than `share` for each post, would be left, for a few rounds, the parts of a
       token outside its main component are compared with `leads` more members of that component;
    3. the parts of each token outside its main component are compared with everything else there.
    """
    near = F.lit(True) if near is None else near
    nodes = members.select("id")
    extra = [c for c in posts.columns if c not in ("token", "unit")]
    several = members.filter("id <> unit").select("unit").distinct()
    if not several.isEmpty():  # a token of its own for each unit of several members, whose parts are compared under it
        alone = posts.join(several, "unit", "left_semi").withColumns({f"{c}2": F.col(c) for c in extra}).filter(near).groupBy("unit").agg(F.max(F.struct(F.lit(0), *extra)).alias("x"))
        own = alone.select(F.xxhash64("unit").cast(posts.schema["token"].dataType).alias("token"), "unit", *[F.col(f"x.{c}").alias(c) for c in extra])
    else:
        own = None
    heads = posts.groupBy("token").agg(F.min(F.struct("unit", *extra)).alias("h"), F.max("unit").alias("z")).filter("h.unit <> z")
    heads = written(heads.select("token", F.col("h.unit").alias("a"), *[F.col(f"h.{c}").alias(f"{c}2") for c in extra]))
    posts = posts.join(heads, "token")
    star = posts.filter((F.col("unit") != F.col("a")) & near).select("a", F.col("unit").alias("b")).unionByName(members.filter("id <> unit").select(F.col("unit").alias("a"), F.col("id").alias("b")))
    posts = posts.select("token", "unit", *extra)
    posts = posts if own is None else posts.unionByName(own)
    star = written(star.distinct())
    links = durable(verify(star) if links is None else verify(star).unionByName(links))
    release(star)
    size, open_ = posts.count(), None
    for no in range(rounds + 1):
        label = durable(components(nodes, links))
        tidy(nodes.sparkSession)
        inside = durable(members.join(label, "id"))
        parts = inside.groupBy("unit", "component").agg(F.min("id").alias("rep"))
        where = posts.join(parts, "unit")
        main = durable(
            where.groupBy("token", "component")
            .agg(F.count("*").alias("c"))
            .groupBy("token")
            .agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"))
            .filter(F.col("most") < F.col("all"))
        )
        left = main.agg(F.sum((F.col("all") - F.col("most")) * F.col("all")).alias("pairs"), F.sum(F.col("all") - F.col("most")).alias("posts")).first()
        if not left["posts"]:
            return label
        if open_ is not None:
            release(open_)
        open_ = written(where.join(main.select("token", "main"), "token"))  # only tokens of several components go on
        if no == rounds or left["pairs"] <= max(share * size, few):
            break
        picked = [F.min_by("rep", F.xxhash64("rep", F.lit(no * leads + i))) for i in range(leads)]
        lead = open_.filter("component = main").groupBy("token").agg(F.array_distinct(F.array(*picked)).alias("a")).select("token", F.explode("a").alias("a"))
        star = written(open_.filter("component <> main").select("token", F.col("rep").alias("b")).join(lead, "token").select("a", "b").distinct())
        links = durable(links.unionByName(verify(star)))
        release(star)
    one, other = F.struct("unit", "component"), F.struct(F.col("unit2").alias("unit"), F.col("component2").alias("component"))
    rest = (
        open_.filter("component <> main")
        .select("token", "unit", "component", *extra)
        .join(open_.select("token", *[F.col(c).alias(f"{c}2") for c in ("unit", "component", *extra)]), "token")
        .filter((F.col("component") != F.col("component2")) & near)
        .select(F.least(one, other).alias("x"), F.greatest(one, other).alias("y"))
        .distinct()
    )
    rest = (
        rest.join(inside.select(one.alias("x"), F.col("id").alias("a")), "x")
        .join(inside.select(one.alias("y"), F.col("id").alias("b")), "y")
        .select("a", "b")
        .distinct()
    )
    return components(nodes, links.unionByName(durable(verify(written(rest)))))
