"""Operators on small tables made by hand, for cases that the comparison with SQL can't show."""

import pytest
from pyspark.sql import functions as F

from tessera import shipping
from tessera.functions import expressions
from tessera.operators import filedeps, graph, portfolio, review, search, traverse
from tessera.plans.bindings import oracle
from tessera.sources import purl
from tessera.streaming import streams

EDGES = "occurrence string, source string, target string, kind string, confidence double, reason string"


@pytest.fixture(scope="module")
def calls(spark):
    """Two ways from open to close, of two and three steps, a way back, a loop and a parallel edge."""
    pairs = [("open", "parse", 0.95), ("parse", "close", 0.5), ("open", "check", None), ("check", "write", 0.8), ("write", "close", 0.8), ("close", "open", 0.5), ("write", "write", None), ("open", "parse", 0.5)]
    return spark.createDataFrame([(f"k{i}", s, t, "calls", c, None) for i, (s, t, c) in enumerate(pairs)], EDGES)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_impact_stops_at_unlikely_edges(spark, calls):
    roots = spark.createDataFrame([(1, "open")], "query_id int, node string")
    assert rows(traverse.impact(calls, roots, 3, "outgoing"), "node", "depth") == [("check", 1), ("close", 2), ("parse", 1), ("write", 2)]
    assert rows(traverse.impact(calls, roots, 3, "outgoing", least=0.6), "node", "depth") == [("check", 1), ("close", 3), ("parse", 1), ("write", 2)]
    tests = spark.createDataFrame([("check",)], "occurrence string")
    assert rows(traverse.impact(calls, roots, 3, "outgoing", without=tests), "node", "depth") == [("close", 2), ("parse", 1)]


def test_trace_takes_the_shorter_way(spark, calls):
    req = spark.createDataFrame([(1, "open", "close"), (2, "open", "nowhere"), (3, "write", "write"), (4, "check", "parse")], "query_id int, root string, goal string")
    got = {r.query_id: (r.status, r.path) for r in traverse.trace(calls, req, 5).collect()}
    assert got == {1: ("ok", ["open", "parse", "close"]), 2: ("no_path", None), 3: ("ok", ["write"]), 4: ("ok", ["check", "write", "close", "open", "parse"])}


def test_edges_keep_loops_and_parallels(spark, calls):
    roots = spark.createDataFrame([(1, "open")], "query_id int, node string")
    assert rows(traverse.traverse_edges(calls, roots, 4), "edge") == [(f"k{i}",) for i in range(8)]


def test_containers_cost_nothing(spark):
    edges = spark.createDataFrame([("c1", "box", "m", "contains", None, None), ("e1", "user", "m", "calls", None, None), ("e2", "far", "user", "calls", None, None)], EDGES)
    nodes = spark.createDataFrame([("box", "class"), ("m", "method"), ("user", "function"), ("far", "function")], "occurrence string, kind string")
    roots = spark.createDataFrame([(1, "box")], "query_id int, node string")
    assert rows(traverse.impact_radius(nodes, edges, roots, 2), "node", "depth") == [("far", 2), ("user", 1)]


def test_strong_components(spark):
    deps = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "a")], "source_path string, target_path string")
    assert rows(traverse.strong_components(deps), "path", "component") == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c")]


def test_strong_components_at_the_end_of_a_long_chain(spark):
    chain = [(f"p{i:03}", f"p{i + 1:03}") for i in range(1, 70)] + [("p070", "p069"), ("p050", "p050"), (None, "p001")]
    deps = spark.createDataFrame(chain, "source_path string, target_path string")
    assert rows(traverse.strong_components(deps), "path", "component", "files") == [("p069", "p069", 2), ("p070", "p069", 2)]
    between = [("a", "b"), ("b", "a")] + [(x, y) for x, y in zip("bcdef", "cdefg", strict=True)] + [("g", "f")]
    assert rows(traverse.strong_components(spark.createDataFrame(between, deps.schema)), "path", "component") == [("a", "a"), ("b", "a"), ("f", "f"), ("g", "f")]
    assert rows(traverse.strong_components(deps.limit(0)), "path", "component", "files") == []


def test_cycles_equal_a_walk(spark):
    """Two components, one with overlapping cycles, walked in order of paths."""
    deps = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "b"), ("m", "n"), ("n", "m"), ("a", "m"), ("z", "a")]
    got = traverse.cycles(spark.createDataFrame(deps, "source_path string, target_path string"))
    assert rows(got, "component", "cycle") == [("a", ["a", "b"]), ("a", ["a", "b", "c"]), ("a", ["b", "c"]), ("m", ["m", "n"])]
    assert rows(traverse.cycles(spark.createDataFrame([("a", "b")], "source_path string, target_path string")), "component") == []


def test_content_hash_minds_rows_not_order(spark, calls):
    digest = lambda df: [(r.kind, r.digest, r.rows) for r in graph.content_hash(df, ["kind"], ["occurrence", "source", "target"]).collect()]
    one = digest(calls)
    assert digest(calls.repartition(5).orderBy(F.desc("target"))) == one and one[0][2] == 8
    assert digest(calls.withColumn("target", F.when(F.col("occurrence") == "k3", "other").otherwise(F.col("target")))) != one
    assert digest(calls.unionByName(calls.limit(1)))[0][1] != one[0][1]


def test_null_confidence_passes(spark, calls):
    nodes = spark.createDataFrame([("open", "a.go"), ("check", "b.go"), ("parse", "b.go"), ("write", None)], "occurrence string, path string")
    assert rows(filedeps.pairs(nodes, calls, 0.96), "source_path", "target_path", "refs") == [("a.go", "b.go", 1)]
    assert graph.neighbors(calls, spark.createDataFrame([(1, "open")], "query_id int, root string"), "outgoing", least=0.96).count() == 1


def test_purl_and_csv(spark):
    df = spark.createDataFrame([("pkg:npm/%40scope/name@1.0?a=b",), ("pkg:pypi/x",), ("npm/x",), (None,)], "p string")
    got = [r.u and (r.u.type, r.u.namespace, r.u.name, r.u.version, r.u.qualifiers) for r in df.select(purl.parse_purl(F.col("p")).alias("u")).collect()]
    assert got == [("npm", "@scope", "name", "1.0", {"a": "b"}), ("pypi", None, "x", None, None), None, None]
    cells = spark.createDataFrame([("=1+1",), ("ok",), (None,), ("|x",)], "c string").select(portfolio.csv_cell("c").alias("c"))
    assert [r.c for r in cells.collect()] == ["'=1+1", "ok", "", "'|x"]


POLICY = expressions.Policy({"approved": ["MIT", "Apache-2.0"], "review_required": ["LGPL-2.1-only", "*"], "prohibited": ["GPL-3.0-only"]}, or_later=True)


@pytest.mark.parametrize(
    ("expression", "verdict"),
    [
        ("MIT", "approved"), ("mit or gpl-3.0-only", "approved"), ("MIT AND GPL-3.0-only", "prohibited"), ("MIT AND Foo", "unknown"), ("GPL-3.0-only OR LGPL-2.1-only", "review_required"), (None, "unknown"),
        ("(MIT OR GPL-3.0-only) AND Apache-2.0", "approved"), ("MIT OR GPL-3.0-only AND Apache-2.0", "approved"), ("(MIT OR Apache-2.0) AND GPL-3.0-only", "prohibited"), ("LGPL-2.1-or-later", "review_required"), ("GPL-3.0-only+", "prohibited"),
        ("MIT WITH LLVM-exception", "review_required"), ("MIT WITH Odd-exception", "unknown"), ("LicenseRef-own", "review_required"), ("MIT AND (", "unknown"),
    ],
)
def test_policy(expression, verdict):
    assert POLICY.judge(expression)[0] == verdict


def test_policy_over_rows(spark):
    df = spark.createDataFrame([(1, "MIT OR GPL-3.0-only"), (2, "MIT"), (3, None), (1, "MIT OR GPL-3.0-only")], "id int, e string")
    got = rows(expressions.verdicts(df, "e", POLICY), "id", "verdict", "acceptable")
    assert got == [(1, "approved", ["MIT"]), (1, "approved", ["MIT"]), (2, "approved", []), (3, "unknown", [])]


@pytest.mark.parametrize(("expression", "family"), [("LGPL-2.1-only AND Foo", "weak_copyleft"), ("MPL-2.0 AND NOASSERTION", "weak_copyleft"), ("mit", "permissive"), ("GPL-3.0", "strong_copyleft"), ("UNLICENSED", "other"), ("MIT OR NOASSERTION", "unknown"), ("GPL-2.0+ WITH Classpath-exception-2.0", "strong_copyleft"), ("", "unknown"), (None, "unknown")])
def test_family(spark, expression, family):
    assert spark.createDataFrame([(expression,)], "e string").select(expressions.family(F.col("e"))).first()[0] == family


def test_assessment_ignores_order_and_spelling(spark):
    ev = [("a", "MIT", 1, "registry_npm"), ("a", "NOASSERTION", 2, "producer_declared"), ("a", "(mit)", 3, "producer_declared"), ("b", "MIT", 1, "registry_npm"), ("b", "ISC", 2, "producer_declared"), ("c", "NONE", 1, "registry_npm"), ("d", None, 1, "registry_npm"), ("e", "MIT or isc", 1, "producer_declared"), ("f", "MIT", 1, "registry_npm"), ("f", "none", 2, "producer_declared")]
    seen = []
    for order in (ev, ev[::-1]):
        got = review.assess(spark.createDataFrame(order, "name string, license_raw string, id int, source string"), ["name"])
        assert rows(got, "name", "status") == [("a", "resolved"), ("b", "conflict"), ("c", "unlicensed"), ("d", "unknown"), ("e", "declared"), ("f", "conflict")]
        seen.append(rows(got, "name", "fingerprint", "detail"))
        assert {r.name: r.detail for r in got.collect()}["b"] == "producer_declared: ISC | registry_npm: MIT"
    assert seen[0] == seen[1]


def test_stream_state_survives_batches(spark, tmp_path):
    """Three files, one batch each: what is current comes from the batch before; a failed arrival moves nothing."""
    batches = [[(1, 1, 5), (2, 1, None)], [(1, 2, 5), (1, 3, None), (2, 2, 7)], [(1, 4, 6), (2, 3, 7), (1, 5, 6)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "key long, id long, digest long").coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    events = spark.readStream.schema("key long, id long, digest long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {(r.key, r.id): r.outcome for r in streams.drain(streams.publications(events)).collect()}
    assert got == {(1, 1): "published", (2, 1): "failed", (1, 2): "unchanged", (1, 3): "failed", (2, 2): "published", (1, 4): "published", (2, 3): "unchanged", (1, 5): "unchanged"}


def test_shared_folder_is_needed_on_clusters(spark, monkeypatch):
    class Far:
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": lambda self: {}, "getCheckpointDir": lambda self: None})()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shipping.shared_dir(Far())


def test_compare_mirrors(spark):
    cols = "ecosystem string, namespace string, name string, version string, license_raw string"
    a = spark.createDataFrame([("x", None, "p", "1", "MIT"), ("x", None, "q", "1", None)], cols)
    b = spark.createDataFrame([("x", None, "p", "1", "ISC"), ("x", None, "r", None, "MIT")], cols)
    assert rows(portfolio.compare(a, b, ["ecosystem"]), "change", "n") == [("added", 1), ("license_changed", 1), ("removed", 1)]
    assert rows(portfolio.compare(a, a, ["ecosystem"]), "change", "n") == []


def test_search_terms_and_files(spark):
    corpus = spark.createDataFrame([("r", "a/x.go", "one Two\nthree\ntwo one"), ("r", "b/y.py", "two one"), ("r", "c", None)], "repository string, path string, text string")
    assert rows(search.search(corpus, 'file:\\.go$ "two" one', context=1), "path", "line_no", "preview") == [("a/x.go", 1, "one Two\nthree"), ("a/x.go", 3, "three\ntwo one")]
    with pytest.raises(ValueError):
        search.search(corpus, "(?i)x", regex=True)


def test_oracle_orders_facts():
    sql = oracle("WITH q AS (SELECT 1 FROM {edges}) SELECT * FROM q")
    assert sql.index("entities AS") < sql.index("edges AS") < sql.index("q AS")
