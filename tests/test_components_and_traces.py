"""Components and traces against plain walks: any graph, long rings and tails, ties, fronts that meet anywhere."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.operators import traverse

EDGES = "occurrence string, source string, target string, kind string, confidence double"


def components_of(pairs):
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
    nodes = {x for p in pairs for x in p}

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in to.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {n: reach(n) for n in nodes}
    out = {n: {m for m in far[n] if n in far[m]} | {n} for n in nodes}
    return {n: (min(own), len(own)) for n, own in out.items() if len(own) > 1}


def found(spark, pairs):
    got = traverse.strong_components(spark.createDataFrame(pairs, "source_path string, target_path string")).collect()
    assert len({r.path for r in got}) == len(got)
    return {r.path: (r.component, r.files) for r in got}


def graph(seed):
    rng = random.Random(seed)
    names = [f"f{i:02d}" for i in range(40)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range((10, 30, 45, 60, 40, 50)[seed])}
    way = lambda *x: set(zip(x, x[1:]))  # noqa: E731, B905
    pairs |= way("a0", "a1", "a2", "a3", "a0") | way("b0", "b1", "b0")  # rings by themselves
    pairs |= way("f01", "r1", "r2", "r3", "f02") | way("f03", "s1", "s2", "f03")  # runs from node to node, and back to their own
    pairs |= way("f01", "u1", "u2", "f02") | way("t1", "t2", "t3", "t4", "t5", "t6", "t7", "f05") | way("f06", *[f"e{i}" for i in range(9)])
    pairs |= way("x", "y1", "y2", "z", "w1", "w2", "x") | way("x", "v1", "v2", "z")  # two ways out, one back
    return {(f"{seed}{a}", f"{seed}{b}") for a, b in pairs}


def test_components_of_any_graph(spark):
    """Six graphs beside each other, from a few edges to one large component."""
    pairs = set().union(*(graph(seed) for seed in range(6)))
    assert found(spark, sorted(pairs)) == components_of(pairs)


def test_no_cycles_and_no_rows(spark):
    assert found(spark, [("a", "b"), ("b", "c"), ("a", "a")]) == {}
    assert traverse.strong_components(spark.createDataFrame([], "source_path string, target_path string")).collect() == []


def rounds(monkeypatch):
    kept = []
    for name in ("durable", "written"):
        monkeypatch.setattr(traverse, name, lambda df, f=getattr(traverse, name): kept.append(1) or f(df))
    return kept


def test_a_ring_of_100000_files_takes_few_rounds(spark, monkeypatch):
    kept, n = rounds(monkeypatch), 100_000
    ids = spark.range(n)
    name = lambda c: F.format_string("f%06d", c)
    one = ids.select(F.concat(F.lit("g"), name("id")).alias("source_path"), F.concat(F.lit("g"), name((F.col("id") + 1) % n)).alias("target_path"))
    got = traverse.strong_components(one)
    assert got.agg(F.count("*"), F.min("component"), F.max("component"), F.min("files")).first() == (n, "gf000000", "gf000000", n)
    assert len(kept) < 40


def test_a_ladder_takes_few_rounds(spark, monkeypatch):
    """Two ways side by side that join at each rung, back to the start: no runs, so colours must jump."""
    kept, n = rounds(monkeypatch), 200
    pairs = [(f"{a}{i:04d}", f"{b}{(i + 1) % n:04d}") for i in range(n) for a in "ab" for b in "ab"]
    assert found(spark, pairs) == {f"{a}{i:04d}": ("a0000", 2 * n) for i in range(n) for a in "ab"}
    assert len(kept) < 70


def path_of(edges, root, goal, depth):
    """Breadth first from the root; a node's first edge is the least by rank, then parent, then edge."""
    rank = {"calls": 1, "references": 6}
    at, level, first = {root: 0}, [root], {}
    for d in range(1, depth + 1):
        best = {}
        for rk, a, e, b in sorted((rank[k], a, e, b) for e, a, b, k in edges if at.get(a) == d - 1):
            if b not in at:
                best.setdefault(b, a)
        at |= dict.fromkeys(best, d)
        first |= best
    if goal not in at:
        return None
    out = deque([goal])
    while out[0] != root:
        out.appendleft(first[out[0]])
    return list(out)


def calls(seed):
    """Edges and requests of one graph: ties, a long way, a hub, requests without a way, and those that name no node."""
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(30)]
    edges = [(f"e{i}", rng.choice(names), rng.choice(names), rng.choice(("calls", "references"))) for i in range((25, 45, 70, 120)[seed])]
    edges += [(f"c{i}", f"m{i}", f"m{i + 1}", "calls") for i in range(7)] + [("h", "m0", names[0], "calls")] + [(f"k{i}", names[0], n, "calls") for i, n in enumerate(names)]
    asked = [(rng.choice(names), rng.choice(names)) for _ in range(12)] + [("m0", "m7"), ("m0", "m6"), ("m3", "m3"), ("m7", "m0"), ("none", "m0"), ("n01", None)]
    of = lambda x: x and f"{seed}{x}"
    return [(of(e), of(a), of(b), k) for e, a, b, k in edges], [(of(a), of(b)) for a, b in asked]


@pytest.mark.parametrize("depth", [1, 6])
def test_traces_from_both_ends(spark, depth):
    edges, asked = (sum(x, []) for x in zip(*(calls(seed) for seed in range(4)), strict=True))
    req = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "query_id int, root string, goal string")
    got = {r.query_id: r for r in traverse.trace(spark.createDataFrame([(*e, None) for e in edges], EDGES), req, depth, ["calls", "references"]).collect()}
    assert len(got) == len(asked)
    for i, (root, goal) in enumerate(asked):
        want = path_of(edges, root, goal, depth)
        assert (got[i].path, got[i].hops, got[i].status) == ((want, len(want) - 1, "ok") if want else (None, None, "no_path")), (i, root, goal)
