"""Answers for a task in words: what is relevant, how it ranks, and how much source each file may show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import durable
from .discovery import normalise
from .graph import relation_rank

# Fixed values: (files of the corpus below which a row counts, source units, files shown).
BUDGETS = ((150, 13_000, 4), (500, 18_000, 5), (None, 24_000, 8))
CLIFF_SHARE, CLIFF, FLOOR, AFFORD, HEADER, CEILING = 0.15, 10.0, 700, 900, 200, 0.7


def _undirected(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    e = edges.filter(F.col("kind").isin(kinds)) if kinds else edges.filter("kind <> 'contains'")
    e = e.select("source", "target", relation_rank().alias("rank"))
    return e.select(F.col("source").alias("here"), F.col("target").alias("there"), "rank").unionByName(e.select(F.col("target").alias("here"), F.col("source").alias("there"), "rank")).groupBy("here", "there").agg(F.min("rank").alias("rank"))


def relevant_context(edges: DataFrame, ranked: DataFrame, budget: int = 40, entries: int = 3, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) around the best hits of each query. ranked: query_id, occurrence, score, r, as discover gives them.

    The first `entries` hits of at least `least` are entry points; their neighbours in both directions follow by relation
    rank and name, up to three quarters of the budget; then two passes over extends and implements from what is kept, up to
    the budget. links are all edges other than contains between kept nodes, once per (source, target, kind).
    nodes: (query_id, node, role, place).
    """
    entry = ranked.filter(F.col("score") >= least).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("r"))).filter(F.col("place") <= entries)
    kept = durable(entry.select("query_id", F.col("occurrence").alias("node"), F.lit("entry").alias("role"), F.col("place").cast("long").alias("place")))

    def grow(kept: DataFrame, step: DataFrame, role: str, most: int) -> DataFrame:
        new = kept.select("query_id", F.col("node").alias("here")).join(step, "here").groupBy("query_id", F.col("there").alias("node")).agg(F.min("rank").alias("rank"))
        new = new.join(kept.select("query_id", "node"), ["query_id", "node"], "left_anti")
        have = kept.groupBy("query_id").agg(F.count("*").alias("have"))
        w = Window.partitionBy("query_id").orderBy("rank", "node")
        new = new.join(have, "query_id").withColumn("place", (F.col("have") + F.row_number().over(w)).cast("long")).filter(F.col("place") <= most)
        return durable(kept.unionByName(new.select("query_id", "node", F.lit(role).alias("role"), "place")))

    kept = grow(kept, _undirected(edges), "neighbor", budget - budget // 4)
    types = durable(_undirected(edges, ["extends", "implements"]))
    for _ in range(2):
        kept = grow(kept, types, "hierarchy", budget)
    ids = kept.select("query_id", "node")
    e = edges.filter("kind <> 'contains'").select("source", "target", "kind").distinct()
    links = ids.withColumnRenamed("node", "source").join(e, "source").join(ids.withColumnRenamed("node", "target"), ["query_id", "target"], "left_semi")
    return kept, links.select("query_id", "source", "target", "kind")


def evidence_rank(ranked: DataFrame, nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, occurrence, evidence, place): hits again by how many of the question's segments their names hold, else as they were.

    ranked: query_id, occurrence, r; terms: query_id, term. A segment in name or qualified name counts 1; one of more than five letters
    that only fits without its -ing counts 2.
    """
    text = normalise(F.concat_ws(" ", "name", "qualified_name"))
    worth = F.when(F.contains("text", F.col("term")), 1).when(F.endswith("term", F.lit("ing")) & (F.octet_length("term") > 5) & F.contains("text", F.substring(F.col("term"), F.lit(1), F.char_length("term") - 3)), 2).otherwise(0)
    known = ranked.select("query_id", "occurrence", "r").join(nodes.select("occurrence", text.alias("text")), "occurrence")
    seen = known.join(terms, "query_id", "left").groupBy("query_id", "occurrence", "r").agg(F.coalesce(F.sum(worth), F.lit(0)).alias("evidence"))
    w = Window.partitionBy("query_id").orderBy(F.desc("evidence"), "r")
    return seen.withColumn("place", F.row_number().over(w)).select("query_id", "occurrence", "evidence", "place")


def exact_name_rank(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, occurrence, place): hits of one name change places among themselves; the places of other names stay.

    For questions that name their seeds. ranked: query_id, occurrence, r, generated, ambient, test, deprioritised. Of a name, hits with fewer
    of the four penalties come first, then those with fewer bytes of signature and documentation, then by occurrence.
    """
    size = F.octet_length(F.coalesce("signature", F.lit(""))) + F.octet_length(F.coalesce("documentation", F.lit("")))
    known = ranked.join(nodes.select("occurrence", normalise(F.col("name")).alias("name"), size.alias("size")), "occurrence")
    penalties = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("generated", "ambient", "test", "deprioritised")), F.lit(0))
    # a nameless hit is a group of its own
    group = [F.col("query_id"), F.col("name"), F.when(F.col("name") == "", F.col("occurrence"))]
    by_r, by_rank = Window.partitionBy(*group).orderBy("r"), Window.partitionBy(*group).orderBy(penalties, "size", "occurrence")
    numbered = known.withColumn("no", F.row_number().over(by_rank)).withColumn("seat", F.row_number().over(by_r))
    member, seat = numbered.select("query_id", "name", F.when(F.col("name") == "", F.col("occurrence")).alias("lone"), "occurrence", "no"), numbered.select("query_id", "name", F.when(F.col("name") == "", F.col("occurrence")).alias("lone"), F.col("r").alias("place"), F.col("seat").alias("no"))
    same = member["query_id"].eqNullSafe(seat["query_id"]) & (member["name"] == seat["name"]) & member["lone"].eqNullSafe(seat["lone"]) & (member["no"] == seat["no"])
    return member.join(seat, same).select(member["query_id"], "occurrence", "place")


def code_priority(nodes: DataFrame, edges: DataFrame, roots: DataFrame, blocks: int, units: int) -> DataFrame:
    """(query_id, occurrence, priority, no, shown): whose code a task shows first. roots: query_id, node.

    The roots (0), then functions and methods next to a root that is one (1), then classes next to any root (2); within a
    priority by relation rank and occurrence; at most `blocks`, each cut to `units` characters of its documentation column
    text where nodes have one.
    """
    kinds = nodes.select(F.col("occurrence").alias("node"), "kind")
    r = roots.select("query_id", "node").distinct().join(kinds, "node")
    near = r.select("query_id", F.col("node").alias("here"), F.col("kind").alias("root_kind")).join(_undirected(edges), "here").join(kinds.withColumnRenamed("node", "there"), "there")
    run = ("function", "method")
    p = F.when(F.col("kind").isin(*run) & F.col("root_kind").isin(*run), 1).when(F.col("kind") == "class", 2)
    near = near.select("query_id", F.col("there").alias("node"), p.alias("priority"), "rank").filter("priority IS NOT NULL")
    all_ = r.select("query_id", "node", F.lit(0).alias("priority"), F.lit(0).alias("rank")).unionByName(near)
    best = all_.groupBy("query_id", "node").agg(F.min(F.struct("priority", "rank")).alias("b"))
    w = Window.partitionBy("query_id").orderBy("b.priority", "b.rank", "node")
    top = best.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= blocks)
    text = F.col("text") if "text" in nodes.columns else F.col("qualified_name")
    shown = nodes.select(F.col("occurrence").alias("node"), F.substring(text, 1, units).alias("shown"))
    return top.join(shown, "node").select("query_id", F.col("node").alias("occurrence"), "b.priority", "no", "shown")


def budget(files: int) -> tuple[int, int]:
    """(source units, files shown) for a corpus of so many files."""
    return next((units, most) for below, units, most in BUDGETS if below is None or files < below)


def allowances(candidates: DataFrame, units: int, most_files: int) -> DataFrame:
    """(query_id, path, allowance, cliffed): how many characters of each file an answer shows.

    candidates: query_id, path, place, score, worth, pinned, spine. A file weighs score times worth (0 to 1), twice on the
    spine; pinned ones weigh as much as the heaviest. Files under 15 % of the heaviest, or 10 if that is less, fall off the
    cliff unless pinned or on the spine; of the rest the first most_files by place stay, then the heaviest that the units can
    feed at 900 each (pinned and spine ones always). What the units leave after 200 for each file is shared: an equal floor of
    up to 700, the spare by weight; none gets more than 70 % of the units.
    """
    q = Window.partitionBy("query_id")
    w = F.greatest(F.col("score"), F.lit(0.0)) * F.greatest(F.least(F.col("worth"), F.lit(1.0)), F.lit(0.0)) * F.when(F.col("spine"), 2).otherwise(1)
    c = candidates.withColumn("w", w).withColumn("top", F.max("w").over(q))
    c = c.withColumn("w", F.when(F.col("pinned"), F.greatest("w", "top", F.lit(1.0))).otherwise(F.col("w"))).withColumn("top", F.max("w").over(q))
    safe = F.col("pinned") | F.col("spine")
    c = c.filter("top > 0").withColumn("in", safe | (F.col("w") >= F.least(F.col("top") * CLIFF_SHARE, F.lit(CLIFF))))
    c = c.withColumn("in", F.col("in") & (F.sum(F.col("in").cast("int")).over(q.orderBy("place")) <= most_files))
    n = F.sum(F.col("in").cast("int")).over(q)
    by_weight = F.row_number().over(Window.partitionBy("query_id", "in").orderBy(F.desc("w"), "place"))
    afford = max(1, units // AFFORD)
    c = c.withColumn("n", n).withColumn("by_weight", by_weight)
    c = c.withColumn("in", F.col("in") & (safe | (F.col("n") <= afford) | (F.col("by_weight") <= afford)))
    c = c.withColumn("n", F.sum(F.col("in").cast("int")).over(q)).withColumn("total", F.sum(F.when(F.col("in"), F.col("w")).otherwise(0.0)).over(q))
    pool = F.greatest(F.lit(units) - HEADER * F.col("n"), F.lit(0))
    floors = F.least(pool, FLOOR * F.col("n"))
    share = F.floor(floors / F.col("n")) + F.floor((pool - floors) * F.col("w") / F.col("total"))
    allowed = F.when(F.col("in"), F.least(share, F.lit(int(units * CEILING + 0.5)))).otherwise(0)
    return c.select("query_id", "path", allowed.cast("long").alias("allowance"), (~F.col("in")).alias("cliffed"))


def explore(nodes: DataFrame, edges: DataFrame, ranked: DataFrame, pinned: DataFrame, corpus_files: int, generated: Column, penalised: Column, roots: int = 10) -> DataFrame:
    """(query_id, path, score, worth, pinned, place, allowance, cliffed): the files of an answer and what each may show.

    ranked: query_id, occurrence, score, r, as discover gives them; pinned: query_id, path, named in the query. A file's
    score is the sum of its hits' scores; files one step from one of the first `roots` hits, either way, score at least
    max(1, a quarter of that root's file). A file is worth 1, or 0.5 if penalised (a test, ambient, deprioritised), or 0.3 if
    generated. Order: pinned, score times worth, path. generated and penalised are conditions on path.
    """
    at = nodes.filter("path IS NOT NULL").select("occurrence", "path")
    own = durable(ranked.join(at, "occurrence").select("query_id", "occurrence", "path", "score", "r"))
    by = own.groupBy("query_id", "path").agg(F.sum("score").alias("score"))
    near = own.filter(F.col("r") <= roots).select("query_id", F.col("occurrence").alias("here"), "path").join(by, ["query_id", "path"]).select("query_id", "here", F.greatest(F.lit(1.0), F.col("score") * 0.25).alias("score"))
    near = near.join(_undirected(edges).select("here", "there"), "here").join(at.withColumnRenamed("occurrence", "there"), "there").groupBy("query_id", "path").agg(F.max("score").alias("near"))
    named = pinned.select("query_id", "path", F.lit(True).alias("pinned")).distinct()
    all_ = by.join(near, ["query_id", "path"], "full").join(named, ["query_id", "path"], "full")
    score = F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("near", F.lit(0.0)))
    worth = F.when(generated, 0.3).when(penalised, 0.5).otherwise(1.0)
    c = all_.select("query_id", "path", F.round(score, 6).alias("score"), worth.alias("worth"), F.coalesce("pinned", F.lit(False)).alias("pinned"), F.lit(False).alias("spine"))
    w = Window.partitionBy("query_id").orderBy(F.desc("pinned"), F.desc(F.col("score") * F.col("worth")), "path")
    c = durable(c.withColumn("place", F.row_number().over(w)))
    return c.join(allowances(c, *budget(corpus_files)), ["query_id", "path"]).select("query_id", "path", "score", "worth", "pinned", "place", "allowance", "cliffed")
