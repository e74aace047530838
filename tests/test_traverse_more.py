"""Traversals whose rounds must not grow with what they walk: containment chains, and traces that stop at their goal."""

import random

import pytest

from tessera.operators import traverse

EDGES = "occurrence string, source string, target string, kind string, confidence double"


def contains(spark, pairs):
    return spark.createDataFrame([(f"c{i}", a, b, "contains", None) for i, (a, b) in enumerate(pairs)], EDGES)


def depths_of(nodes, pairs):
    above = {n: {a for a, b in pairs if b == n} for n in nodes}
    out = {}
    for n in nodes:
        seen, todo = set(), list(above[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += above[x]
        out[n] = len(seen)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_containment_depth_of_any_graph(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(40)]
    pairs = {(nodes[rng.randrange(i)], nodes[i]) for i in range(1, 30)}  # a forest
    pairs |= {(rng.choice(nodes), rng.choice(nodes)) for _ in range((0, 3, 8, 20)[seed])}  # knots, loops and cycles
    pairs |= {(nodes[30 + i], nodes[30 + (i + 1) % 4]) for i in range(4)} | {(nodes[30], nodes[35]), (nodes[35], nodes[36])}
    got = traverse.containment_depth(contains(spark, sorted(pairs)), spark.createDataFrame([(n,) for n in nodes], "occurrence string"))
    assert {r.occurrence: r.depth for r in got.collect()} == depths_of(nodes, pairs)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, kept = 10_000, []
    monkeypatch.setattr(traverse, "durable", lambda df, f=traverse.durable: kept.append(1) or f(df))
    edges = contains(spark, [(f"n{i}", f"n{i + 1}") for i in range(n)])
    got = traverse.containment_depth(edges, spark.createDataFrame([(f"n{i}",) for i in (0, 1, 777, n)], "occurrence string"))
    assert {r.occurrence: r.depth for r in got.collect()} == {"n0": 0, "n1": 1, "n777": 777, f"n{n}": n}
    assert len(kept) <= 22


def test_a_trace_ends_at_its_goal(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(traverse, "durable", lambda df, f=traverse.durable: kept.append(1) or f(df))
    edges = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i + 1}", "calls", None) for i in range(40)] + [("x", "n0", "n2", "calls", None)], EDGES)
    req = spark.createDataFrame([(1, "n0", "n3"), (2, "n1", "n1"), (3, "n5", "n4")], "query_id int, root string, goal string")
    got = {r.query_id: (r.status, r.hops, r.path) for r in traverse.trace(edges, req.filter("query_id < 3"), 30).collect()}
    assert got == {1: ("ok", 2, ["n0", "n2", "n3"]), 2: ("ok", 0, ["n1"])}
    assert len(kept) < 40
    assert traverse.trace(edges, req.filter("query_id = 3"), 6).first().status == "no_path"
