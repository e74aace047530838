"""Names that many share, places that several providers hold, lines that many ranges hold."""

from pyspark.sql import functions as F

from tessera.operators import discovery, inspect, lifecycle, navigation, portfolio, traverse


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_one_place_of_several_providers(spark):
    """Places that a request finds with two packages go by provider."""
    req = spark.createDataFrame([(1, 9, p, "k") for p in ("a", "b", "c")], "query_id int, repository_id int, package string, symbol_key string")
    mapping = spark.createDataFrame([(9, "depends_on", p, "automatic") for p in "abc"] + [(r, "provides", p, "automatic") for r, p in ((30, "a"), (4, "b"), (17, "c"))], "repository_id int, relation string, package string, source string")
    uploads = spark.createDataFrame([(r, r) for r in (4, 17, 30)], "repository_id int, upload_id int")
    places = spark.createDataFrame([(r, "k", "f", 7) for r in (30, 17, 4)], "upload_id int, symbol_key string, path string, line int")
    for order in ("upload_id", "-upload_id"):
        got = lifecycle.approximate_locations(req, req.limit(0).select("query_id"), mapping, uploads, places.orderBy(F.expr(order)), 2)
        assert rows(got, "no", "provider") == [(1, 4), (2, 17)]


def test_a_name_that_many_declare(spark):
    """20,000 references of one name to 20,000 declarations of it: no pairs. What is single in a tier decides."""
    refs = spark.range(20_000).select(F.col("id").alias("reference_id"), F.lit("f").alias("path"), F.lit("m").alias("module"), F.lit("n").alias("name"), F.when(F.col("id") == 7, "s7").alias("symbol"))
    decl = spark.range(20_000).select(F.concat(F.lit("d"), "id").alias("occurrence"), F.when(F.col("id") == 5, "f").otherwise(F.concat(F.lit("g"), "id")).alias("path"), F.lit("m").alias("module"), F.lit("n").alias("name"), F.concat(F.lit("s"), "id").alias("symbol"))
    none = spark.createDataFrame([], "path string, module string, name string, alias string")
    got = lifecycle.resolve(refs, decl, none)
    assert rows(got.groupBy("tier", "target").count(), "tier", "target", "count") == [(1, "d7", 1), (4, "d5", 19_999)]
    assert lifecycle.resolve(refs, decl.filter("path <> 'f'"), none).count() == 1


def test_tiers_of_imports(spark):
    refs = spark.createDataFrame([(1, "f", "m", "x", None), (2, "f", "m", "y", None), (3, "f", "m", "z", None), (4, "f", "m", "w", None), (4, "f", "m", "x", None), (5, None, None, None, None)], "reference_id int, path string, module string, name string, symbol string")
    decl = spark.createDataFrame([("a", "g", "p", "x", None), ("b", "g", "p", "own", None), ("c", "h", "q", "z", None), ("d", "h", "q", "z", None), ("e", "i", "m", "z", None), ("e", "j", "m", "z", None)], "occurrence string, path string, module string, name string, symbol string")
    imports = spark.createDataFrame([("f", "p", "x", None), ("f", "p", "x", None), ("f", "p", "own", "y"), ("f", "q", None, None)], "path string, module string, name string, alias string")
    # two z in q decide nothing; one z of the own module, declared in two files, does
    assert rows(lifecycle.resolve(refs, decl, imports), "reference_id", "tier", "target") == [(1, 2, "a"), (2, 2, "b"), (3, 5, "e"), (4, 2, "a")]


def test_a_line_that_many_ranges_hold(spark):
    """20,000 references on a line and 20,000 definitions around it, but two ranges: no pairs."""
    refs = spark.range(20_000).select(F.col("id").alias("reference_id"), F.lit(1).alias("upload_id"), F.lit("f").alias("path"), F.when(F.col("id") == 3, 90).otherwise(50).alias("line"))
    defs = spark.range(20_000).select(F.col("id").alias("definition_id"), F.lit(1).alias("upload_id"), F.lit("f").alias("path"), F.when(F.col("id") % 2 == 0, 40).otherwise(10).alias("from_line"), F.lit(60).alias("to_line"))
    got = navigation.enclosing(refs, defs)
    assert rows(got.groupBy("definition_id").count(), "definition_id", "count") == [(19_998, 19_999)]


def test_a_name_is_not_inside_its_definition(spark):
    defs = spark.createDataFrame([("outer", 1, "f", 1, 30, 1, 5), ("inner", 1, "f", 10, 20, 10, 5), ("twin", 1, "f", 10, 20, 10, 9), ("bare", 1, "f", 12, 13, None, None)], "definition_id string, upload_id int, path string, from_line int, to_line int, name_line int, name_character int")
    refs = spark.createDataFrame([(1, 1, "f", 10, 5), (2, 1, "f", 10, 9), (3, 1, "f", 10, 7), (4, 1, "f", 1, 5), (5, 1, "f", 12, 5), (6, 1, "f", 31, 0)], "reference_id int, upload_id int, path string, line int, character int")
    assert rows(navigation.enclosing(refs, defs), "reference_id", "definition_id") == [(1, "twin"), (2, "inner"), (3, "twin"), (5, "bare")]


def test_options_that_many_declare(spark):
    """10,000 requests for a name and a prefix that 10,000 options have: no pairs."""
    nodes = spark.range(10_000).select(F.format_string("o%05d", "id").alias("occurrence"), F.lit("nix").alias("language"), F.lit("p").alias("path"), F.lit(1).alias("line"), F.lit("a.b").alias("name"))
    req = spark.range(20_000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("a.b").alias("text"))
    got = inspect.dotted_options(nodes, req, prefixed=3, limit=2)
    assert rows(got.groupBy("occurrence", "tier", "no").count(), "occurrence", "tier", "no", "count") == [("o00000", 1, 1, 10_000), ("o00000", 2, 1, 10_000), ("o00001", 1, 2, 10_000), ("o00001", 2, 2, 10_000)]


def test_texts_are_measured_once(spark):
    """Requests with the same text, and nodes of the same name, are one pair: it is measured once."""
    names = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("occurrence"), F.when(F.col("id") % 2 == 0, "bolted").otherwise("ring").alias("name"))
    req = spark.range(1000).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "bxlted").otherwise("rings").alias("text"))
    got = discovery.fuzzy(names, req)
    assert rows(got.groupBy("edit_distance").count(), "edit_distance", "count") == [(1, 1_000_000)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan  # it lies behind the durable pairs


def test_cycles_are_handed_on_as_found(spark, monkeypatch):
    """A dense component: cycles come in pieces, in the order of one walk."""
    n = 40
    deps = spark.createDataFrame([(f"p{i:02}", f"p{j:02}") for i in range(n) for j in range(n)] + [("x", "y"), ("y", "x")], "source_path string, target_path string")
    got = rows(traverse.cycles(deps), "component", "no", "cycle")
    way = [f"p{i:02}" for i in range(n)]
    assert [c for _, _, c in got if c[0] != "x"] == [way[j : i + 1] for i in range(n) for j in range(i)]
    assert [no for c, no, _ in got if c == "p00"] == list(range(n * (n - 1) // 2)) and got[-1] == ("x", 0, ["x", "y"])
    monkeypatch.setattr(traverse, "CYCLED", 7)
    assert rows(traverse.cycles(deps), "component", "no", "cycle") == got


def test_levels_are_those_of_a_search(spark):
    """The same nodes and depths as with ways, loops and several roots included."""
    step = spark.createDataFrame([("a", "b", 0, ""), ("b", "c", 0, ""), ("c", "a", 0, ""), ("c", "d", 0, ""), ("d", "d", 0, "")], "here string, there string, rank int, edge string")
    roots = spark.createDataFrame([(1, "a"), (1, "c"), (2, "d"), (3, "nowhere")], "query_id int, node string")
    for depth in (1, 2, 9):
        assert rows(traverse.levels(step, roots, depth), "query_id", "node", "depth") == rows(traverse.bfs(step, roots, depth), "query_id", "node", "depth")


def test_compared_snapshots(spark):
    """What both have, an edge without a name too, is no change; licences count once for each pair of elements that differ."""
    comps = spark.createDataFrame([(1, "e", "x", None, "p", "1", "MIT"), (1, "e", "x", None, "p", "1", None), (2, "e", "x", None, "p", "1", "MIT"), (2, "f", "x", None, "q", "1", "ISC")], "snapshot_id int, element_id string, ecosystem string, namespace string, name string, version string, license_raw string")
    edges = spark.createDataFrame([(1, "a", "R", None), (2, "a", "R", None), (2, "a", "R", "b")], "snapshot_id int, from_element string, relationship string, to_element string")
    snaps = spark.createDataFrame([(1, "o"), (2, "p")], "id int, outcome string")
    got = portfolio.compare_snapshots(comps, edges, snaps, spark.createDataFrame([(7, 1, 2)], "pair_id int, before int, after int"))
    assert rows(got, "pair_id", "change", "n") == [(7, "added", 1), (7, "changed_outcome", 1), (7, "edge_added", 1), (7, "license_changed", 1)]
