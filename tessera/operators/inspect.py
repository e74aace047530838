"""Looking at one thing: definitions behind a name, an entity with its neighbours, a file with its outline, a name's blast radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import RELATIONS, neighbors, relation_rank
from .traverse import bfs, impact_radius

CALL_LIKE = ("calls", "imports", "instantiates", "navigates", "references")
TYPE_KINDS = ("class", "interface", "enum", "type_alias", "struct", "trait", "protocol")


def file_nodes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The file nodes of the paths. paths: path; may repeat."""
    return nodes.filter("kind = 'file'").join(paths.select("path").distinct(), "path", "left_semi")


def spelled_variants(nodes: DataFrame, req: DataFrame, generated: Column | None = None, limit: int = 50) -> DataFrame:
    """(query_id, occurrence, no): symbols by spelled name. req: query_id, text.

    A spelling is a name, a file name without its extension, name/arity (the number goes), or parts joined by ::, . or /,
    of which the last is the name and each other one is a part of the qualified name or a folder of the path;
    crate, super and self say nothing. Generated files come last, then path and line; at most `limit` for each request.
    """
    whole = F.regexp_replace("text", r"/\d+$", "")
    parts = F.filter(F.split(whole, r"::|\.|/"), lambda p: p != "")
    q = req.select("query_id", whole.alias("whole"), F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~p.isin("crate", "super", "self")).alias("hints"), F.try_element_at(parts, F.lit(-1)).alias("last"))
    q = q.select("query_id", "whole", "hints", F.explode(F.array_distinct(F.array("whole", "last"))).alias("name"))
    stem = F.when(F.col("kind") == "file", F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.[^.]*$", ""))
    known = nodes.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array("name", stem)))))
    hit = q.join(known.withColumnRenamed("name", "own"), F.col("name") == F.col("key"))
    fits = (F.col("name") == F.col("whole")) | F.forall("hints", lambda h: F.contains(F.col("qualified_name"), h) | F.array_contains(F.split("path", "/"), h))
    last = F.coalesce(generated, F.lit(False)) if generated is not None else F.lit(False)
    hit = hit.filter(fits).select("query_id", "occurrence", last.alias("g"), "path", "line").distinct()
    w = Window.partitionBy("query_id").orderBy("g", "path", "line", "occurrence")
    return hit.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= limit).select("query_id", "occurrence", "no")


def group_definitions(found: DataFrame, req: DataFrame) -> DataFrame:
    """(query_id, path, qualified_name, definitions, occurrence, unmatched): what a name defines, once per place.

    found: query_id, occurrence, path, qualified_name. req: query_id, file, by which a request narrows to paths that are
    the file or end in it; where none does all stay, unmatched. Null files don't narrow.
    """
    by = found.groupBy("query_id", "path", "qualified_name").agg(F.count("*").alias("definitions"), F.min("occurrence").alias("occurrence"))
    by = by.join(req.select("query_id", "file"), "query_id")
    fits = F.coalesce((F.col("path") == F.col("file")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("file"))), F.lit(False))
    by = by.withColumn("fits", fits).withColumn("any", F.max("fits").over(Window.partitionBy("query_id")))
    return by.filter(F.col("fits") | ~F.col("any")).select("query_id", "path", "qualified_name", "definitions", "occurrence", (F.col("file").isNotNull() & ~F.col("any")).alias("unmatched"))


def dotted_options(nodes: DataFrame, req: DataFrame, language: str = "nix", prefixed: int = 12, limit: int = 10) -> DataFrame:
    """(query_id, occurrence, tier, no) of dotted options: the declaration options.X, X itself, then names under X. req: query_id, text."""
    own = nodes.filter(F.col("language") == language).select("occurrence", "name", "path", "line")
    # the order doesn't depend on who asks: of a name or prefix the first rows are kept before requests meet them
    first = lambda rows, key, order, k: rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("r") <= k)
    place = ["path", "line", "occurrence"]
    exact = req.select("query_id", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.concat(F.lit("options."), F.col("text")).alias("name")), F.struct(F.lit(1).alias("tier"), F.col("text").alias("name")))).alias("x")).select("query_id", "x.*").join(first(own, "name", place, limit).drop("r"), "name")
    # names meet by each of their dotted prefixes, not by a scan for each request
    parts = F.split("name", r"\.")
    above = own.filter(F.contains("name", F.lit("."))).withColumn("text", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))))
    above = first(above, "text", ["name", *place], prefixed).drop("r")
    under = first(req.join(above, "text"), "query_id", ["name", *place], prefixed).withColumn("tier", F.lit(2))
    cols = ["query_id", "tier", "name", "path", "line", "occurrence"]
    w = Window.partitionBy("query_id").orderBy("tier", "name", "path", "line", "occurrence")
    return exact.select(*cols).unionByName(under.select(*cols)).withColumn("no", F.row_number().over(w)).filter(F.col("no") <= limit).select("query_id", "occurrence", "tier", "no")


def inspect_entity(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, neighbours). found: query_id, occurrence, as a selector gives it; requests without a match aren't in it.

    entities: (query_id, status, matches, occurrence, callers, callees, unresolved): ok with one match, else ambiguous with
    the smallest occurrence; callers and callees at one step and the references out of the entity that nothing resolved, by
    which the answer is incomplete. neighbours: (query_id, direction, neighbor, edges) of those with status ok.
    """
    by = found.groupBy("query_id").agg(F.count("*").alias("matches"), F.min("occurrence").alias("occurrence"))
    one = by.filter("matches = 1").select("query_id", F.col("occurrence").alias("root"))
    each = [neighbors(edges, one, d, ["calls"]).select("query_id", F.lit(name).alias("direction"), "neighbor") for d, name in (("incoming", "callers"), ("outgoing", "callees"))]
    near = each[0].unionByName(each[1]).groupBy("query_id", "direction", "neighbor").agg(F.count("*").alias("edges"))
    n = near.groupBy("query_id").agg(F.count_if(F.col("direction") == "callers").alias("callers"), F.count_if(F.col("direction") == "callees").alias("callees"))
    open_ = unresolved.groupBy(F.col("source").alias("occurrence")).agg(F.count("*").alias("unresolved"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = by.join(n, "query_id", "left").join(open_, "occurrence", "left")
    return out.select("query_id", F.when(F.col("matches") == 1, "ok").otherwise("ambiguous").alias("status"), "matches", "occurrence", zero("callers"), zero("callees"), zero("unresolved")), near


def inspect_file(nodes: DataFrame, edges: DataFrame, files: DataFrame, req: DataFrame, depth: int = 32, first: int = 0, size: int = 200) -> tuple[DataFrame, DataFrame]:
    """(files, outline) of requested paths; req: query_id, path.

    files: the file facts with the number of entities in it. outline: (query_id, occurrence, kind, name, line, level, no), a
    page of the entities by line, level by contains from the file node (null outside its tree). Source lines come from
    search.file_range.
    """
    own = nodes.filter("kind <> 'file'").select("occurrence", "path", "kind", "name", "line")
    n = own.groupBy("path").agg(F.count("*").alias("entities"))
    facts = req.join(files, "path").join(n, "path", "left").withColumn("entities", F.coalesce("entities", F.lit(0)))
    step = edges.filter("kind = 'contains'").select(F.col("source").alias("here"), F.col("target").alias("there"), F.lit(0).alias("rank"), F.col("occurrence").alias("edge"))
    roots = req.join(nodes.filter("kind = 'file'").select("path", "occurrence"), "path").select("query_id", F.col("occurrence").alias("node"))
    tree = bfs(step, roots, depth).select("query_id", F.col("node").alias("occurrence"), F.col("depth").alias("level"))
    w = Window.partitionBy("query_id").orderBy("line", "occurrence")
    rows = req.join(own, "path").join(tree, ["query_id", "occurrence"], "left").withColumn("no", F.row_number().over(w))
    return facts, rows.filter((F.col("no") > first) & (F.col("no") <= first + size)).select("query_id", "occurrence", "kind", "name", "line", "level", "no")


def legacy_neighbors(nodes: DataFrame, edges: DataFrame, req: DataFrame, derived: Column, limit: int | None = None) -> DataFrame:
    """Neighbours as the older symbol view shows them: (query_id, root, neighbor, relation, edge, no).

    req: query_id, root, relation, direction. Files and repositories are no neighbours; for edges of derived generations
    extends reads type_of as well. Parallel edges come by the neighbour's place.
    """
    at = nodes.filter("kind NOT IN ('file', 'repository')").select(F.col("occurrence").alias("neighbor"), "path", "line")
    shown = F.when(derived & (F.col("kind") == "type_of"), F.array(F.lit("type_of"), F.lit("extends"))).otherwise(F.array("kind"))
    e = edges.withColumn("relation", F.explode(shown))
    out = None
    for direction, here, there in (("outgoing", "source", "target"), ("incoming", "target", "source")):
        one = req.filter(F.col("direction") == direction).join(e.select(F.col(here).alias("root"), F.col(there).alias("neighbor"), "relation", F.col("occurrence").alias("edge")), ["root", "relation"])
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("query_id").orderBy("path", "line", "neighbor", "edge")
    out = out.join(at, "neighbor").withColumn("no", F.row_number().over(w))
    out = out if limit is None else out.filter(F.col("no") <= limit)
    return out.select("query_id", "root", "neighbor", "relation", "edge", "no")


def context_of_names(nodes: DataFrame, edges: DataFrame, req: DataFrame, limit: int) -> DataFrame:
    """(query_id, status, direction, kind, node, no) of symbols by exact name and kind; req: query_id, name, kind.

    With one symbol its neighbours by relation and direction, `limit` of each; with more the candidates, ambiguous; with none
    nothing.
    """
    from .lifecycle import symbol_context

    hit = req.join(nodes.select("occurrence", "name", "kind"), ["name", "kind"])
    n = hit.withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    one = symbol_context(edges, n.filter("n = 1").select("query_id", F.col("occurrence").alias("root")), limit).withColumn("status", F.lit("ok"))
    w = Window.partitionBy("query_id").orderBy("occurrence")
    many = n.filter("n > 1").withColumn("no", F.row_number().over(w)).filter(F.col("no") <= limit)
    none = F.lit(None).cast("string")
    cols = ["query_id", "status", "direction", "kind", "node", "no"]
    return one.select(*cols).unionByName(many.select("query_id", F.lit("ambiguous").alias("status"), none.alias("direction"), none.alias("kind"), F.col("occurrence").alias("node"), "no"))


def related(edges: DataFrame, nodes: DataFrame, req: DataFrame, direction: str, limit: int = 100) -> DataFrame:
    """Callers (incoming) or callees (outgoing) of what a name names: (query_id, definition, other, kind, edge, no).

    req: query_id, name. Neighbours over call-like relations, each once by its first edge, `limit` for each definition.
    """
    here, there = ("source", "target") if direction == "outgoing" else ("target", "source")
    named = req.join(nodes.filter("kind <> 'file'").select(F.col("occurrence").alias("definition"), "name"), "name")
    e = edges.filter(F.col("kind").isin(*CALL_LIKE)).groupBy(F.col(here).alias("definition"), F.col(there).alias("other")).agg(F.min(F.struct(relation_rank().alias("rank"), F.col("occurrence").alias("edge"), "kind")).alias("f"))
    w = Window.partitionBy("query_id", "definition").orderBy("f.rank", "f.edge")
    return named.join(e, "definition").withColumn("no", F.row_number().over(w)).filter(F.col("no") <= limit).select("query_id", "definition", "other", "f.kind", "f.edge", "no")


def radius_of_names(nodes: DataFrame, edges: DataFrame, req: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(reached, links): the impact radius of all definitions of a name together. req: query_id, name.

    reached: (query_id, node, depth), the least over the definitions. links: edges other than contains between what is
    reached and the definitions, once per (source, target, kind).
    """
    roots = req.join(nodes.filter("kind <> 'file'").select(F.col("occurrence").alias("node"), "name"), "name").select("query_id", "node")
    reached = impact_radius(nodes, edges, roots, depth)
    all_ = reached.select("query_id", "node").unionByName(roots).distinct()
    e = edges.filter("kind <> 'contains'").select("source", "target", "kind").distinct()
    links = all_.withColumnRenamed("node", "source").join(e, "source").join(all_.withColumnRenamed("node", "target"), ["query_id", "target"], "left_semi")
    return reached, links.select("query_id", "source", "target", "kind")


def blast_summary(radius: DataFrame, nodes: DataFrame, test_pattern: str, top: int = 40) -> tuple[DataFrame, DataFrame]:
    """(summary, files) of an impact radius: direct dependents, all within it, files, test files and routes; top files by symbols."""
    at = radius.join(nodes.select(F.col("occurrence").alias("node"), "path", "kind"), "node")
    test = F.col("path").rlike(test_pattern)
    summary = at.groupBy("query_id").agg(
        F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("within"), F.countDistinct("path").alias("files"), F.countDistinct(F.when(test, F.col("path"))).alias("test_files"), F.count_if(F.col("kind") == "route").alias("routes")
    )
    by = at.filter("path IS NOT NULL").groupBy("query_id", "path").agg(F.count("*").alias("symbols"))
    w = Window.partitionBy("query_id").orderBy(F.desc("symbols"), "path")
    return summary, by.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= top)


def type_relations(edges: DataFrame, nodes: DataFrame, req: DataFrame) -> DataFrame:
    """What a type has to do with others: (query_id, role, other, edges). req: query_id, root.

    Outgoing: types, returned, referenced (types only) and overrides; incoming: users (type_of) and returners.
    """
    types = nodes.filter(F.col("kind").isin(*TYPE_KINDS)).select(F.col("occurrence").alias("neighbor"))
    out = neighbors(edges, req, "outgoing", ["type_of", "returns", "overrides"]).select("query_id", F.when(F.col("kind") == "type_of", "types").when(F.col("kind") == "returns", "returned").otherwise("overrides").alias("role"), "neighbor")
    out = out.unionByName(neighbors(edges, req, "outgoing", ["references"]).join(types, "neighbor", "left_semi").select("query_id", F.lit("referenced").alias("role"), "neighbor"))
    out = out.unionByName(neighbors(edges, req, "incoming", ["type_of", "returns"]).select("query_id", F.when(F.col("kind") == "type_of", "users").otherwise("returners").alias("role"), "neighbor"))
    return out.groupBy("query_id", "role", F.col("neighbor").alias("other")).agg(F.count("*").alias("edges"))


assert set(CALL_LIKE) <= set(RELATIONS)
