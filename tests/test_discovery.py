"""Discovery by hand: parsing, word forms, penalties, pins, the fuzzy tier, confidence."""

import pytest

from tessera.operators import discovery as d
from pyspark.sql import functions as F

NODES = "occurrence string, kind string, name string, qualified_name string, path string, language string, signature string, documentation string"
PB = r"\.pb\.go$"


def forms(spark, *words):
    return {r.w: set(r.v) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", d.variants(F.col("w")).alias("v")).collect()}


def test_word_forms(spark):
    got = forms(spark, "caching", "services", "running", "parser", "hopped", "entities", "decision", "agreement", "speed", "class", "ring", "bed")
    assert {"cach", "cache"} < got["caching"] and {"service", "servic"} < got["services"] and {"runn", "runne", "run"} < got["running"]
    assert {"pars", "parse"} < got["parser"] and {"hoppe", "hopp"} < got["hopped"] and "entity" in got["entities"] and "decis" in got["decision"] and "agree" in got["agreement"]
    assert got["speed"] == {"speed"} and got["class"] == {"class"} and got["ring"] == {"ring"} and got["bed"] == {"bed"}


def test_filters_and_what_stays_text(spark):
    text = 'kind:function kind:class LANG:Go path:"src/my dir" name:Auth unknown:thing kind:bogus lang:nope authenticate'
    r = d.parse(spark.createDataFrame([(1, text), (2, None), (3, "path: x")], "query_id int, text string")).orderBy("query_id").collect()
    assert (r[0].kinds, r[0].languages, r[0].paths, r[0].names, r[0].text) == (["function", "class"], ["go"], ["src/my dir"], ["auth"], "unknown:thing kind:bogus lang:nope authenticate")
    assert (r[1].text, r[1].kinds) == ("", []) and (r[2].text, r[2].paths) == ("path: x", [])


@pytest.mark.parametrize("text", ["HTMLParser", "html_parser", "html-parser", "html.parser"])
def test_identifier_spellings(spark, text):
    (r,) = d.plan(spark.createDataFrame([(1, text)], "query_id int, text string")).collect()
    assert {"html", "parser"} <= set(r.terms)


def test_terms_of_a_question(spark):
    rows = [(1, "how does this code work", None), (2, "MegaProject backend", ["Mega-Project"]), (3, "références", None), (4, "x", None), (5, "Cache cache CACHE", None)]
    got = {r.query_id: r for r in d.plan(spark.createDataFrame(rows, "query_id int, text string, project array<string>")).collect()}
    assert got[1].terms == [] and got[2].terms == ["backend"] and "reference" in got[3].terms
    assert got[4].single and got[4].terms == ["x"] and len(got[5].groups) == 1
    assert "megaproject" not in got[2].symbols and got[3].symbols == ["references"]


def test_normalised_letters(spark):
    (r,) = spark.createDataFrame([("Ünïcode Çà ǖ Ḗ ΆΒ \x00é",)], "t string").select(d.normalise(F.col("t")).alias("n")).collect()
    assert r.n == "unicode ca u e αβ  e"


@pytest.fixture(scope="module")
def world(spark):
    rows = [
        ("plain", "function", "cacheStore", "a.cacheStore", "src/a.go", "go", None, None),
        ("both", "interface", "cacheStore", "b.cacheStore", "api/types.pb.go", "go", None, None),  # generated and ambient
        ("test", "function", "cacheStore", "c.cacheStore", "tests/c.go", "go", None, None),
        ("doc", "function", "other", "d.other", "src/d.go", "go", None, "Fills the cache of a store."),
        ("loose", "variable", "cacheStore", "e.cacheStore", "src/e.go", "go", None, None),
        ("file", "file", "src/a.go", "src/a.go", "src/a.go", "go", None, None),
        ("caller", "function", "run", "f.run", "src/f.go", "go", None, None),
        ("typo", "function", "authorise", "g.authorise", "src/g.go", "go", None, None),
        ("ab", "function", "ab", "h.ab", "src/h.go", "go", None, None),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    edges = spark.createDataFrame([("caller", "plain", "calls"), ("plain", "plain", "calls"), ("caller", "doc", "imports")], "source string, target string, kind string")
    files = spark.createDataFrame([(p, None, None) for p in {r[4] for r in rows}], "path string, generated boolean, errors string")
    return d.projection(nodes, edges, files, PB), d.postings(nodes), nodes, edges, files


def ask(spark, world, text, **more):
    wanted = {k: more.pop(k) for k in ("symbols", "files") if k in more}
    req = spark.createDataFrame([(1, text, *wanted.values())], ", ".join(["query_id int", "text string", *[f"{k} array<string>" for k in wanted]]))
    found = d.discover(world[0], world[1], req, **more)
    return {r.occurrence: r for r in found.collect()}, d.confidence(req, found).collect()[0]


def test_penalties(spark, world):
    pj = {r.occurrence: r for r in world[0].collect()}
    assert pj["both"].generated and pj["both"].ambient and pj["test"].test and pj["plain"].usage == 2 and pj["loose"].usage == 0
    got, sure = ask(spark, world, "cache stores")
    # generated and ambient: the lesser factor, not the product
    plain = got["plain"].score / (1 + 0.2 * 2 + 100 * (r := (got["plain"].score - 1.4) / 100))
    assert plain == pytest.approx(1)
    assert got["both"].score == pytest.approx((1 + 100 * r) * 0.3, rel=1e-6) and got["test"].score == pytest.approx((1 + 100 * r) * 0.5, rel=1e-6) and got["loose"].score == pytest.approx((1 + 100 * r) * 0.08, rel=1e-6)
    assert got["plain"].corroborated and not got["both"].corroborated and not got["loose"].corroborated and got["doc"].corroborated and "documentation" in got["doc"].fields
    assert min(got.values(), key=lambda x: x.r).occurrence == "plain" and sure.confidence == "discovery_only"


def test_wanted_rows_are_spared_and_first(spark, world):
    got, _ = ask(spark, world, "store", symbols=["CacheStore"], deprioritised=F.col("path") == "tests/c.go")
    first = {o for o, r in got.items() if r.pinned}
    assert first == {"plain", "both", "test", "loose"} and max(got[o].r for o in first) == 4
    rank = (got["plain"].score - 1.4) / 100
    assert got["both"].score == pytest.approx(1 + 100 * rank, rel=1e-6) and got["test"].score == pytest.approx((1 + 100 * rank) * 0.25, rel=1e-6)
    # a word of the text pins too, but not a deprioritised row
    got, _ = ask(spark, world, "cacheStore", deprioritised=F.col("path") == "tests/c.go")
    assert {o for o, r in got.items() if r.pinned} == {"plain", "both", "loose"}


def test_rank_of_places(spark, world):
    post = {(r.occurrence, r.term): r.weight for r in world[1].collect()}
    # ab: twice in name (word and segment), qualified name a and ab twice: A A B B
    assert post["ab", "ab"] == pytest.approx((1 + 1 / 4 + 0.25 / 9 + 0.25 / 16) / 1.64493406685)
    assert post["doc", "cache"] == pytest.approx((0.05 + 0.05 / 4) / 1.64493406685)


def test_second_tier_only_without_hits(spark, world):
    got, sure = ask(spark, world, "autorise")
    assert set(got) == {"typo"} and got["typo"].fuzzy and got["typo"].edit_distance == 1 and got["typo"].score == pytest.approx(0.5) and got["typo"].fields == ["name"]
    got, _ = ask(spark, world, "abb")  # three letters: one edit
    assert set(got) == {"ab"}
    assert ask(spark, world, "aq")[0] == {}  # two letters: no second tier
    assert ask(spark, world, "kind:class autorise")[0] == {}
    got, sure = ask(spark, world, "ab")
    assert got["ab"].pinned and not got["ab"].fuzzy and sure.status == "candidates"


def test_filters_alone_and_confidence(spark, world):
    got, sure = ask(spark, world, "kind:variable")
    assert set(got) == {"loose"} and (sure.status, sure.confidence) == ("candidates", "discovery_only")
    assert ask(spark, world, "zzzqqq")[1].status == "no_entry_point"
    got, sure = ask(spark, world, "r")
    assert "caller" in got and (sure.status, sure.confidence) == ("candidates", "low")


def test_empty_tables(spark, world):
    none = [t.limit(0) for t in world[2:]]
    assert d.discover(d.projection(*none, PB), d.postings(none[0]), spark.createDataFrame([(1, "cache")], "query_id int, text string")).collect() == []
    assert d.discover(world[0], world[1], spark.createDataFrame([], "query_id int, text string")).collect() == []
