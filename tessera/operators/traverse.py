"""Breadth-first traversals of many requests at once: one join for each level, a durable frontier between levels."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import durable, tidy, written
from .graph import CONTAINERS, confident, relation_rank


def steps(edges: DataFrame, kinds: list[str] | None, direction: str, least: float = 0.0, cost: Column | None = None) -> DataFrame:
    """Distinct (here, there, cost, rank, edge): the lowest-ranked edge between two nodes in that direction."""
    here, there = ("source", "target") if direction == "outgoing" else ("target", "source")
    e = edges.filter(confident(least))
    e = e.filter(F.col("kind").isin(kinds)) if kinds else e.filter("kind <> 'contains'")
    first = F.min(F.struct(relation_rank().alias("rank"), F.col("occurrence").alias("edge"), F.col("kind").alias("via")))
    return e.groupBy(F.col(here).alias("here"), F.col(there).alias("there")).agg(first.alias("f")).select("here", "there", "f.rank", "f.edge", "f.via", (F.lit(1) if cost is None else cost).alias("cost"))


def bfs(step: DataFrame, roots: DataFrame, depth: int, goals: DataFrame | None = None) -> DataFrame:
    """(query_id, node, depth, parent, edge): each node a request reaches, at its first depth, by its first edge.

    roots: query_id, node. Ties at one depth go by relation rank, parent, edge. The loop ends at the depth or when no
    request has a frontier left. Visited nodes leave by an anti-join, never through the driver. goals (query_id, node): a
    request goes no further than the level that reaches its goal.
    """
    none = F.lit(None).cast("string")
    front = durable(roots.select("query_id", "node", F.lit(0).alias("depth"), none.alias("parent"), none.alias("edge")).distinct())
    seen = front
    step = durable(step.repartition("here"))  # dealt once by what every level joins
    for d in range(1, depth + 1):
        found = front.select("query_id", F.col("node").alias("here")).join(step, "here")
        first = found.groupBy("query_id", F.col("there").alias("node")).agg(F.min(F.struct("rank", F.col("here").alias("parent"), "edge")).alias("f"))
        new = first.select("query_id", "node", F.lit(d).alias("depth"), "f.parent", "f.edge").join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti")
        front = durable(new)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if goals is not None:
            there = goals.join(front.select("query_id", "node"), ["query_id", "node"], "left_semi").select("query_id")
            front = front.join(there, "query_id", "left_anti")
    return seen


def levels(step: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(query_id, node, depth) of `bfs` without the ways, for tables where most nodes are reached: step (here, there) and fronts are
    compressed tables, and what a level leaves behind goes before the next one."""
    step = written(step.select("here", "there"))
    front = written(roots.select("query_id", "node").distinct().withColumn("depth", F.lit(0)))
    seen = front
    for d in range(1, depth + 1):
        found = front.select("query_id", F.col("node").alias("here")).join(step, "here").select("query_id", F.col("there").alias("node")).distinct()
        front = written(found.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        tidy(step.sparkSession)
    return seen


def impact(edges: DataFrame, roots: DataFrame, depth: int = 3, direction: str = "incoming", kinds: list[str] | None = None, least: float = 0.0, without: DataFrame | None = None) -> DataFrame:
    """Nodes by depth, without the roots. Nodes in without (occurrence), such as those of tests, are neither reached nor gone through."""
    step = steps(edges, kinds or ["calls", "references", "extends", "implements"], direction, least)
    if without is not None:
        step = step.join(without.select(F.col("occurrence").alias("there")), "there", "left_anti")
    return bfs(step, roots, depth).filter("depth > 0")


def call_graph(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """Both directions over call-like relations; a node keeps its least depth."""
    kinds = ["calls", "references", "imports", "instantiates", "navigates"]
    both = [bfs(steps(edges, kinds, d), roots, depth) for d in ("outgoing", "incoming")]
    return both[0].unionByName(both[1]).groupBy("query_id", "node").agg(F.min("depth").alias("depth"))


#: Rows of a front, of some 100 bytes, that a trace broadcasts; they are counted at each level, and larger ones shuffle.
FRONT_ROWS = 200_000


def trace(edges: DataFrame, requests: DataFrame, depth: int = 10, kinds: list[str] | None = None) -> DataFrame:
    """Shortest path of each request from root to goal: (query_id, status, hops, path array).

    requests: query_id, root, goal. Both ends are searched, a level at a time and the smaller front first; a request whose
    fronts meet leaves, and so does one that has no front left on one side. Of several shortest paths it is the one that goes
    back from the goal by the least relation rank, then node, then edge, whichever fronts met. The way back takes as many
    joins as the longest path found has steps.
    """
    step = steps(edges, kinds or ["calls"], "outgoing")
    none = F.lit(None).cast("string")
    out = durable(step.select("here", "there", "rank", "edge").repartition("here"))  # dealt once by what the levels of each side join
    ends = {"out": ("here", "there", out), "in": ("there", "here", durable(out.select("here", "there").repartition("there")))}
    goals = durable(requests.select("query_id", "root", F.col("goal").alias("node"), F.coalesce(F.col("goal") == F.col("root"), F.lit(False)).alias("met")))
    done = goals.filter("met").select("query_id", "node", F.lit(0).alias("depth"), F.lit(0).alias("rest"))
    start = lambda c, own: goals.filter(own).select("query_id", F.col(c).alias("node"), F.lit(0).alias("depth"), none.alias("parent")).distinct()
    seen = {side: start(c, F.lit(True)) for side, c in (("out", "root"), ("in", "node"))}
    front = {side: start(c, ~F.col("met")) for side, c in (("out", "root"), ("in", "node"))}
    level, size = {"out": 0, "in": 0}, dict.fromkeys(front, goals.filter("NOT met").count())
    rows = dict.fromkeys(front, goals.count())
    small = lambda df, n: F.broadcast(df) if n <= FRONT_ROWS else df
    while sum(level.values()) < depth and min(size.values()):
        side = min(("out", "in"), key=lambda x: size[x])
        other = "in" if side == "out" else "out"
        here, there, by = ends[side]
        go = front[side].join(small(front[other].select("query_id").distinct(), size[other]), "query_id", "left_semi")
        found = small(go.select("query_id", F.col("node").alias(here)), size[side]).join(by, here)
        first = F.min(F.struct("rank", F.col("here").alias("parent"), "edge")).getField("parent") if side == "out" else none
        new = found.groupBy("query_id", F.col(there).alias("node")).agg(first.alias("parent")).join(small(seen[side].select("query_id", "node"), rows[side]), ["query_id", "node"], "left_anti")
        level[side] += 1
        meets = front[other].select("query_id", "node", F.lit(True).alias("met"))
        new = durable(new.join(small(meets, size[other]), ["query_id", "node"], "left").select("query_id", "node", F.lit(level[side]).alias("depth"), "parent", F.coalesce("met", F.lit(False)).alias("met")))
        seen[side] = seen[side].unionByName(new.drop("met"))
        both = new.filter("met").select("query_id", "node", F.lit(level["out"]).alias("depth"), F.lit(level["in"]).alias("rest"))
        done = done.unionByName(both)
        front[side] = new.drop("met").join(both.select("query_id").distinct(), "query_id", "left_anti")
        counted = new.agg(F.count("*").alias("all"), F.count_if("met").alias("met")).first()
        rows[side], size[side] = rows[side] + counted["all"], counted["all"] - counted["met"]
    # from where fronts met on to the goal: each level of the way in, by the same first edges
    done = durable(done)
    reached, at = seen["out"].select("query_id", "node", "parent"), done
    ways = seen["in"].select("query_id", F.col("node").alias("there"), F.col("depth").alias("rest"))
    most = done.agg(F.max("rest").alias("rest"), F.max(F.col("depth") + F.col("rest")).alias("hops")).first()
    for _ in range(most["rest"] or 0):
        on = at.filter("rest > 0").select("query_id", F.col("node").alias("here"), "depth", (F.col("rest") - 1).alias("rest")).join(ends["out"][2], "here").join(ways, ["query_id", "there", "rest"])
        first = F.min(F.struct("rank", F.col("here").alias("parent"), "edge"))
        at = durable(on.groupBy("query_id", F.col("there").alias("node"), F.col("rest")).agg(first.alias("f"), F.max("depth").alias("depth")).select("query_id", "node", "depth", "rest", "f.parent"))
        reached = reached.unionByName(at.select("query_id", "node", "parent"))
    hops = done.groupBy("query_id").agg(F.max(F.col("depth") + F.col("rest")).alias("hops"))
    walk = goals.join(hops, "query_id").join(reached, ["query_id", "node"], "left").select("query_id", "hops", F.array("node").alias("path"), "parent")
    back = durable(reached.join(hops, "query_id", "left_semi").select("query_id", F.col("node").alias("parent"), F.col("parent").alias("next")))
    for _ in range(most["hops"] or 0):
        walk = walk.join(back, ["query_id", "parent"], "left").select("query_id", "hops", F.when(F.col("parent").isNotNull(), F.concat(F.array("parent"), "path")).otherwise(F.col("path")).alias("path"), F.col("next").alias("parent"))
    return requests.select("query_id").join(walk, "query_id", "left").select("query_id", F.when(F.col("hops").isNull(), "no_path").otherwise("ok").alias("status"), "hops", "path")


def traverse_edges(edges: DataFrame, roots: DataFrame, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """Every edge occurrence out of the nodes that a request reaches under the depth: parallel, self and back edges too."""
    inner = bfs(steps(edges, kinds, "outgoing"), roots, depth - 1)
    e = edges.filter(F.col("kind").isin(kinds)) if kinds else edges.filter("kind <> 'contains'")
    return inner.select("query_id", F.col("node").alias("source")).join(e, "source").select("query_id", F.col("occurrence").alias("edge"), "source", "target", "kind")


def impact_radius(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, node, depth): dependents at their least cost.

    An incoming edge other than contains costs 1; from a container its outgoing contains edges cost 0, and that
    closure is taken before each level goes on.
    """
    box = nodes.filter(F.col("kind").isin(*CONTAINERS, "file")).select(F.col("occurrence").alias("source"))
    # compressed tables: these two hold an entry for each edge
    inside = written(edges.filter("kind = 'contains'").join(box, "source", "left_semi").select(F.col("source").alias("here"), F.col("target").alias("there")).distinct())
    into = written(edges.filter("kind <> 'contains'").select(F.col("target").alias("here"), F.col("source").alias("there")).distinct())
    # fronts that are small go to the tables of edges, which then needn't be dealt at each level
    small = lambda df: F.broadcast(df) if df.limit(FRONT_ROWS + 1).count() <= FRONT_ROWS else df
    front = durable(roots.select("query_id", "node", F.lit(0).alias("depth")).distinct())
    seen = front
    tidy(nodes.sparkSession)
    for d in range(depth + 1):
        while True:  # what lies inside, and inside that, at the same depth
            more = small(front.select("query_id", F.col("node").alias("here"))).join(inside, "here").select("query_id", F.col("there").alias("node")).distinct()
            more = durable(more.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("depth", F.lit(d)))
            if more.isEmpty():
                break
            seen, front = seen.unionByName(more), more
        if d == depth:
            break
        level = seen.filter(F.col("depth") == d)
        new = small(level.select("query_id", F.col("node").alias("here"))).join(into, "here").select("query_id", F.col("there").alias("node")).distinct()
        front = durable(new.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("depth", F.lit(d + 1)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        tidy(nodes.sparkSession)
    return seen.filter("depth > 0")


def affected_tests(deps: DataFrame, changed: DataFrame, test_pattern: str, depth: int = 5) -> DataFrame:
    """(query_id, path, depth): tests that a changed file reaches backwards over file dependencies.

    changed: query_id, path. Tests are collected, never expanded; a changed test counts itself.
    """
    back = deps.filter(~F.col("target_path").rlike(test_pattern)).select(F.col("target_path").alias("here"), F.col("source_path").alias("there"), F.lit(0).alias("rank"), F.lit("").alias("edge"))
    return bfs(back, changed.select("query_id", F.col("path").alias("node")), depth).filter(F.col("node").rlike(test_pattern)).select("query_id", F.col("node").alias("path"), "depth")


def type_hierarchy(edges: DataFrame, roots: DataFrame, direction: str = "outgoing", depth: int = 8, nodes: DataFrame | None = None) -> DataFrame:
    """Ancestors (outgoing) or descendants (incoming) over extends and implements, by level.

    (query_id, node, depth, parent, edge, relation, heuristic, place): heuristic where the edge has a confidence under
    1; place is the order within a request: level, extends before implements, then name, path and line where nodes are
    given, then the node.
    """
    found = bfs(steps(edges, ["extends", "implements"], direction), roots, depth).filter("depth > 0")
    via = edges.groupBy(F.col("occurrence").alias("edge")).agg(F.min("kind").alias("relation"), (F.min(F.coalesce("confidence", F.lit(1.0))) < 1).alias("heuristic"))
    out = found.join(via, "edge", "left")
    order = [F.col("depth"), relation_rank("relation")]
    if nodes is not None:
        out = out.join(nodes.select(F.col("occurrence").alias("node"), "name", "path", "line"), "node", "left")
        order += [F.col("name"), F.col("path"), F.col("line")]
    w = Window.partitionBy("query_id").orderBy(*order, "node")
    return out.withColumn("place", F.row_number().over(w)).select("query_id", "node", "depth", "parent", "edge", "relation", "heuristic", "place")


#: Kinds whose members can override.
OVERRIDABLE = ("method", "function", "property", "field")


def derived_overrides(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int = 8) -> DataFrame:
    """Members of each focus type that an ancestor's member of the same name precedes: (query_id, member, base_member, base_type, relation).

    roots: query_id, node. Ancestors come in the order of type_hierarchy; the nearest one that has the name wins, within it
    the first member by line. Members are what a type contains.
    """
    facts = nodes.select("occurrence", "name", "kind", "line")
    inside = edges.filter("kind = 'contains'").select(F.col("source").alias("owner"), F.col("target").alias("occurrence")).distinct().join(facts, "occurrence")
    own = roots.select("query_id", F.col("node").alias("owner")).join(inside.filter(F.col("kind").isin(*OVERRIDABLE)), "owner").select("query_id", F.col("occurrence").alias("member"), "name")
    above = type_hierarchy(edges, roots, "outgoing", depth, nodes).select("query_id", F.col("node").alias("owner"), "relation", "place")
    base = above.join(inside, "owner").select("query_id", "name", F.struct("place", "line", F.col("occurrence").alias("base_member"), F.col("owner").alias("base_type"), "relation").alias("b"))
    first = base.groupBy("query_id", "name").agg(F.min("b").alias("b"))
    return own.join(first, ["query_id", "name"]).filter(F.col("member") != F.col("b.base_member")).select("query_id", "member", "b.base_member", "b.base_type", "b.relation")


def containment_depth(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct ancestors of each node over contains, cyclic containment included once.

    Where every ancestor has one container, they are counted by pointer jumping: each round a node takes over what the node that it points
    to points to, so that a chain of n takes some log2 n rounds. Only nodes of several containers, and those that a cycle keeps
    from ending, get the set of all their ancestors; a chain that ends below such a node adds its own length to that
    node's number.
    """
    up = durable(edges.filter("kind = 'contains'").select(F.col("target").alias("node"), F.col("source").alias("above")).distinct())
    count = up.groupBy("node").agg(F.count("*").alias("n"), F.min("above").alias("above"))
    single, knots = durable(count.filter("n = 1").select("node", "above")), durable(count.filter("n > 1").select("node"))
    at = _jumped(single)
    # what still points at a node with a single container goes round a cycle
    looped = at.join(at.select(F.col("node").alias("at")), "at", "left_semi").select("node")
    sets = _ancestors(up, knots.unionByName(looped))
    # chain nodes that are above their own knot are on a cycle through it: they are knots too, and chains end below them
    below = at.join(knots.select(F.col("node").alias("at")), "at", "left_semi")
    again = durable(below.join(sets.select(F.col("node").alias("at"), F.col("above").alias("node")), ["at", "node"], "left_semi").select("node"))
    if not again.isEmpty():
        sets = sets.unionByName(_ancestors(up, again))
        at = _jumped(single.join(again, "node", "left_anti"))
    number = durable(sets.groupBy("node").agg(F.count("*").alias("depth"), F.count_if(F.col("above") != F.col("node")).alias("others")))
    # the end of a chain is among its steps already, even where it is above itself
    chain = at.join(number, "node", "left_anti").join(number.select(F.col("node").alias("at"), F.col("others").alias("more")), "at", "left")
    by = number.drop("others").unionByName(chain.select("node", (F.col("steps") + F.coalesce("more", F.lit(0))).alias("depth")))
    return nodes.select("occurrence").join(by.withColumnRenamed("node", "occurrence"), "occurrence", "left").select("occurrence", F.coalesce("depth", F.lit(0)).alias("depth"))


def _jumped(single: DataFrame) -> DataFrame:
    """(node, at, steps, low): how far each node's chain of single containers goes, where it ends, and the smallest on it;
    a chain that is a ring has no end, and its smallest is that of the ring. single: node, above."""
    at = durable(single.select("node", F.col("above").alias("at"), F.lit(1).cast("long").alias("steps"), F.least("node", "above").alias("low")))
    for _ in range(max(1, at.count().bit_length())):
        on = at.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("low").alias("lower"))
        moved = at.join(on, "at", "left")
        if moved.filter("next IS NOT NULL").isEmpty():
            break
        at = durable(moved.select("node", F.coalesce("next", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.least("low", "lower").alias("low")))
    return at


def _ancestors(up: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, above), each once: all that is above the nodes of starts; goes on until nothing is new."""
    found = front = durable(up.join(starts.distinct(), "node", "left_semi"))
    while True:
        more = front.join(up.select(F.col("node").alias("above"), F.col("above").alias("next")), "above").select("node", F.col("next").alias("above")).distinct()
        front = durable(more.join(found, ["node", "above"], "left_anti"))
        if front.isEmpty():
            return found
        found = durable(found.unionByName(front))


def strong_components(deps: DataFrame) -> DataFrame:
    """(path, component, files): files on common dependency cycles, named by their smallest path, and how many they are.

    Runs of files with one edge in and one out become one edge first, by pointer jumping; a ring of them is a component
    at once. Then forward and backward colouring: a node's colour is the first node, in an order of hashes that changes
    each round, that reaches it; those that reach their colour back within it are one component and leave, the rest go on.
    Colours travel along edges and jump to the colour of their colour, so that rounds don't grow with the length of a way.
    Nodes without incoming or outgoing edges are on no cycle and leave before each round, edges between colours after it.
    """
    edges = durable(deps.select(F.col("source_path").alias("s"), F.col("target_path").alias("t")).filter("s <> t").distinct())
    done = edges.select(F.col("s").alias("path"), F.col("t").alias("component")).filter(F.lit(False))
    edges, runs, rings = _contracted(_trimmed(edges))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        order = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: E731, B023
        nodes = edges.select(F.col("s").alias("n")).unionByName(edges.select(F.col("t").alias("n"))).distinct()
        colour = _spread(edges, nodes.select("n", order("n").alias("k"), F.col("n").alias("c"))).select("n", "c")
        same = durable(edges.join(colour.toDF("s", "cs"), "s").join(colour.toDF("t", "ct"), "t").filter("cs = ct").select("s", "t"))
        # who reaches the colour's own node inside the colour: against the edges that node comes before all others
        own = colour.select("n", F.when(F.col("n") == F.col("c"), F.lit(-(2**63))).otherwise(order("n")).alias("k"), F.col("n").alias("c"))
        ends = _spread(same.select(F.col("t").alias("s"), F.col("s").alias("t")), own)
        back = durable(ends.select("n", "c").join(colour, ["n", "c"], "left_semi"))
        done = done.unionByName(back.select(F.col("n").alias("path"), F.col("c").alias("component")))
        gone = back.select("n")
        edges = _trimmed(same.join(gone.toDF("s"), "s", "left_anti").join(gone.toDF("t"), "t", "left_anti").select("s", "t"))
    if runs is not None:  # a run is on a cycle if both of its ends are in one component, or are one node
        of = lambda c: done.select(F.col("path").alias(c), F.col("component").alias(f"{c}_of"))
        both = runs.join(of("head"), "head", "left").join(of("tail"), "tail", "left").withColumns({f"{c}_of": F.coalesce(f"{c}_of", c) for c in ("head", "tail")}).filter("head_of = tail_of")
        inside = durable(both.select("node", "head", F.col("head_of").alias("component")))
        every = done.unionByName(inside.select(F.col("node").alias("path"), "component")).unionByName(inside.select(F.col("head").alias("path"), "component"))
        done = durable(every.unionByName(rings.select(F.col("node").alias("path"), F.col("low").alias("component"))).distinct())
    name = done.groupBy("component").agg(F.min("path").alias("name"), F.count("*").alias("files")).filter("files > 1")
    return done.join(name, "component").select("path", F.col("name").alias("component"), "files")


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Edges with each run of nodes of one edge in and one out as one edge from its head to its tail; (node, head, tail) of
    the nodes on runs, (node, low) of those on rings of nothing else, named by the smallest. Nothing changes, and there
    are no runs, where few such nodes follow each other: colours jump along those."""
    into = edges.groupBy(F.col("t").alias("node")).agg(F.count("*").alias("i"), F.min("s").alias("before")).filter("i = 1")
    out = edges.groupBy(F.col("s").alias("node")).agg(F.count("*").alias("o"), F.min("t").alias("after")).filter("o = 1")
    single = durable(into.join(out, "node").select("node", "before", "after"))
    inner = durable(single.join(single.select(F.col("node").alias("before")), "before", "left_semi").select("node", F.col("before").alias("above")))
    if inner.count() * RUNS <= edges.count():
        return edges, None, None
    at = _jumped(inner)
    ring = at.join(inner.select(F.col("node").alias("at")), "at", "left_semi").select("node", "low")
    rings = durable(ring)
    # first of a run: the only one whose source is on no run; last: the only one whose target is on none
    firsts = single.join(inner.select("node"), "node", "left_anti").select(F.col("node").alias("first"), F.col("before").alias("head"))
    on = at.select("node", F.col("at").alias("first")).unionByName(firsts.select(F.col("first").alias("node"), "first"))
    lasts = single.join(single.select(F.col("node").alias("after")), "after", "left_anti").select("node", F.col("after").alias("tail"))
    tails = on.join(lasts, "node").select("first", "tail")
    runs = durable(on.join(firsts, "first").join(tails, "first").select("node", "head", "tail"))
    bare = edges.join(single.select(F.col("node").alias("s")), "s", "left_anti").join(single.select(F.col("node").alias("t")), "t", "left_anti").select("s", "t")
    return _trimmed(bare.unionByName(runs.select(F.col("head").alias("s"), F.col("tail").alias("t"))).filter("s <> t").distinct()), runs, rings


def cycles(deps: DataFrame) -> DataFrame:
    """(component, no, cycle): the cycles that a depth-first walk meets inside each component, as arrays of paths.

    The walk takes paths in order, the smallest first, and lists a cycle at each edge back to a path on its way; it
    doesn't list every elementary cycle. Components are walked apart from each other, each in one task, which holds its edges as
    numbers; cycles are handed on as they are found.
    """
    member = durable(strong_components(deps).select("path", "component"))
    s, t = member.toDF("source_path", "component"), member.toDF("target_path", "other")
    inner = deps.select("source_path", "target_path").filter("source_path <> target_path").join(s, "source_path").join(t, "target_path").filter("component = other").select("component", "source_path", "target_path").distinct()

    def walk(component: str, names: list[str], graph: dict[int, array]) -> Iterator[pa.RecordBatch]:
        """The cycles of a component, some CYCLED paths at a time. graph has the targets of each path, by number, in order."""
        order = sorted(range(len(names)), key=names.__getitem__)
        paths = np.array(names, dtype=object)
        seen, no, out, held = set(), 0, [], 0

        def some() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            flat = pa.array(paths[np.concatenate(out)], pa.string())
            return pa.RecordBatch.from_arrays([pa.array([component] * len(out)), pa.array(np.arange(no - len(out), no)), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["component", "no", "cycle"])

        for first in order:
            if first in seen or first not in graph:
                continue
            way, place, todo = array("i", [first]), {first: 0}, [iter(graph[first])]
            seen.add(first)
            while todo:
                nxt = next(todo[-1], None)
                if nxt is None:
                    todo.pop()
                    place.pop(way.pop())
                elif nxt in place:
                    out.append(way[place[nxt] :])
                    no, held = no + 1, held + len(out[-1])
                    if held >= CYCLED:
                        yield some()
                        out, held = [], 0
                elif nxt not in seen:
                    seen.add(nxt)
                    place[nxt] = len(way)
                    way.append(nxt)
                    todo.append(iter(graph.get(nxt, ())))
        if out:
            yield some()

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Components, one after the other, as their edges come: paths are numbers, each path a string once."""
        component, number, graph = None, {}, {}
        for b in batches:
            for c, s_, t_ in zip(*(b.column(k).to_pylist() for k in ("component", "source_path", "target_path")), strict=True):
                if c != component:
                    if graph:
                        yield from walk(component, list(number), graph)
                    component, number, graph = c, {}, {}
                graph.setdefault(number.setdefault(s_, len(number)), array("i")).append(number.setdefault(t_, len(number)))
        if graph:
            yield from walk(component, list(number), graph)

    dealt = inner.repartition("component").sortWithinPartitions("component", "source_path", "target_path")
    return dealt.mapInArrow(walks, "component string, no long, cycle array<string>")


#: Paths of cycles that a walk holds before it hands them on.
CYCLED = 1 << 18
#: Runs are taken together where more than one in so many edges lies inside one.
RUNS = 16
#: Times that ends are cut before the rest, long tails among them, is left to colours.
TRIMS = 4


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose source has an incoming and whose target an outgoing edge, again while some go, TRIMS times at most."""
    edges = durable(edges)
    before = edges.count()
    for _ in range(TRIMS if before else 0):
        ends, starts = edges.select(F.col("t").alias("s")).distinct(), edges.select(F.col("s").alias("t")).distinct()
        edges = durable(edges.join(ends, "s", "left_semi").join(starts, "t", "left_semi").select("s", "t"))
        after = edges.count()
        if after == before:
            break
        before = after
    return edges


def _spread(edges: DataFrame, label: DataFrame) -> DataFrame:
    """The label (k, c), least by k, that reaches each node n. c is a node: a label also jumps to the label of its c."""
    label = written(label)
    while True:
        one = F.struct("k", "c")
        got = edges.join(label.select(F.col("n").alias("s"), "k", "c"), "s").groupBy(F.col("t").alias("n")).agg(F.min(one).alias("d"))
        jump = label.select(F.col("n").alias("c"), F.struct(F.col("k"), F.col("c")).alias("j"))
        new = label.join(got, "n", "left").join(jump, "c").select("n", F.least(one, F.coalesce("d", one), "j").alias("x"), one.alias("old"))
        new = written(new.select("n", "x.k", "x.c", (F.col("x") < F.col("old")).alias("moved")))
        label = new.select("n", "k", "c")
        if new.filter("moved").isEmpty():
            return label
