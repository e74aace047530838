"""Package URLs, exported ids and documents, interfaces by package, re-ranking, bound cursors, by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import evidence, explore, lifecycle
from tessera.sources import purl, sbom


def test_package_urls(spark):
    cases = {
        "pkg:npm/%40scope/left-pad@1.3.0": ("npm", "@scope", "left-pad", "1.3.0", None),
        "pkg:maven/org.example/core@2.1.0?type=jar&classifier=sources": ("maven", "org.example", "core", "2.1.0", {"type": "jar", "classifier": "sources"}),
        "pkg:golang/golang.org/x/text@0.14.0": ("golang", "golang.org/x", "text", "0.14.0", None),
        "pkg:nuget/Newtonsoft.Json": ("nuget", None, "Newtonsoft.Json", None, None),
        "pkg:github/acme/widgets#sub/path": ("github", "acme", "widgets", None, None),
        "PKG:PyPI/requests@2.31.0": ("pypi", None, "requests", "2.31.0", None),
        "pkg://npm/a@1?x=1&x=2&Arch=x%20y+z": ("npm", None, "a", "1", {"x": "2", "arch": "x y z"}),
        "pkg:npm/a+b@1+2?k": ("npm", None, "a+b", "1+2", {"k": ""}),
        "pkg:npm/a@b@2?": ("npm", None, "a@b", "2", None),
    }
    for bad in ("", "npm/left-pad", "pkg:", "pkg:npm", "pkg:npm/", "pkg:npm/%zz@1", "pkg:npm/a?=v", "pkg:npm/@scope/name", "pkg:npm/a%ZZ", "pkg:npm/x//a@1", "pkg:npm/a@%G0", "pkg:npm/a?k=%x", None):
        cases[bad] = None
    got = spark.createDataFrame([(c,) for c in cases], "p string").select("p", purl.parse_purl(F.col("p")).alias("u")).collect()
    assert {r.p: tuple(r.u) if r.u else None for r in got} == cases


def exported(spark, names, edges=(), roots=()):
    comps = spark.createDataFrame([(1, n, e, e, None, None, None, e in roots) for n, e in enumerate(names)], "document_id int, ordinal long, element_id string, name string, version string, purl string, license_raw string, is_root boolean")
    rels = spark.createDataFrame([(1, n, *e) for n, e in enumerate(edges)], "document_id int, ordinal long, from_element string, relationship string, to_element string, resolved boolean")
    (r,) = sbom.export(comps, rels, {"name": 'a "name"', "created": "now", "tool": "t"}).collect()
    return json.loads(r.body)


def one_after_another(elements):
    import re

    used, out = {"SPDXRef-DOCUMENT"}, {}
    for e in elements:
        if e not in out:
            base = re.sub("[^A-Za-z0-9.-]", "-", e)
            base = base if e.startswith("SPDXRef-") else "SPDXRef-" + base
            name, n = base, 2
            while name in used:
                name, n = f"{base}-{n}", n + 1
            used.add(name)
            out[e] = name
    return out


@pytest.mark.parametrize(
    "names",
    [["a", "b"], ["a:b", "a/b", "a b", "a-b"], ["x", "x-2", "SPDXRef-x", "x-2-2", "SPDXRef-x-2"], ["x-2", "x", "SPDXRef-x", "x!", "x-"], ["DOCUMENT", "SPDXRef-DOCUMENT", "DOCUMENT-2", "DOCUMENT!"], ["p-1", "p/1", "p-1-2", "p", "p-", "p--2", "q-1-2-3"]],
)
def test_exported_ids(spark, names, monkeypatch):
    monkeypatch.setattr(sbom, "CHUNK", 2)
    edges = [(names[0], "CONTAINS", n, True) for n in names[1:]] + [(names[0], "DEPENDS_ON", "ghost", False), (names[1], "DESCRIBES", names[0], True), (names[1], "DEPENDS_ON", "SPDXRef-DOCUMENT", True)]
    ids = one_after_another([*names, "SPDXRef-DOCUMENT"])
    doc = exported(spark, names, edges, roots=names[:1])
    assert [(p["SPDXID"], p["name"]) for p in doc["packages"]] == [(ids[n], n) for n in names] and doc["name"] == 'a "name"'
    want = [("SPDXRef-DOCUMENT", "DESCRIBES", ids[names[0]])] + [(ids[a], kind, ids[b]) for a, kind, b, ok in edges if ok and kind != "DESCRIBES"]
    assert [(r["spdxElementId"], r["relationshipType"], r["relatedSpdxElement"]) for r in doc["relationships"]] == want


def test_document_without_relationships(spark):
    assert exported(spark, ["a"])["relationships"] == []


def test_interfaces_embed_within_their_package(spark):
    methods = spark.createDataFrame(
        [("p", "Reader", "interface", "read", "()"), ("q", "Reader", "interface", "read", "()"), ("p", "Closer", "interface", "close", "()"), ("q", "Closer", "interface", "close", "()"), ("p", "File", "class", "read", "()"), ("q", "File", "class", "read", "()")],
        "package string, owner string, kind string, name string, signature string",
    )
    embeds = spark.createDataFrame([("p", "Reader", "Closer")], "package string, interface string, embedded string")
    # in p a Reader must close too; the Reader of q embeds nothing
    assert [tuple(r) for r in lifecycle.satisfies(methods, embeds).collect()] == [("File", "Reader")]


def test_ranking_again(spark):
    nodes = spark.createDataFrame(
        [("a1", "A", "x.A", "sig", None), ("a2", "A", "y.A", None, None), ("b", "B", "z.B", None, None), ("run", "runner", "m.runner", None, None)], "occurrence string, name string, qualified_name string, signature string, documentation string"
    )
    hits = spark.createDataFrame([(1, "a1", 1, False, None, False, False), (1, "b", 2, True, True, False, False), (1, "a2", 3, False, False, False, False), (1, "run", 4, False, False, False, False)], "query_id int, occurrence string, r int, generated boolean, ambient boolean, test boolean, deprioritised boolean")
    order = lambda df: [r.occurrence for r in df.orderBy("place").collect()]
    none = spark.createDataFrame([], "query_id int, term string")
    assert order(explore.evidence_rank(hits, nodes, none)) == ["a1", "b", "a2", "run"]
    terms = spark.createDataFrame([(1, "running"), (1, "z")], "query_id int, term string")
    assert order(explore.evidence_rank(hits, nodes, terms)) == ["run", "b", "a1", "a2"]  # runn fits and counts two
    assert order(explore.evidence_rank(hits, nodes, spark.createDataFrame([(1, "ring"), (1, "z")], "query_id int, term string"))) == ["b", "a1", "a2", "run"]  # too short to be cut
    assert order(explore.exact_name_rank(hits, nodes)) == ["a2", "b", "a1", "run"]


def test_cursors_are_bound(spark):
    matched = spark.createDataFrame([(q, i // 2, f"k{i}") for q in (1, 2) for i in range(5)], "query_id int, a int, b string")
    ask = lambda cursor, filter_="f": spark.createDataFrame([(1, "s", filter_, cursor)], "query_id int, scope string, filter string, cursor string")
    seen, cursor = [], None
    while True:
        page = evidence.bound_pages(ask(cursor), matched, ["a", "b"], 2).orderBy("no").collect()
        assert {r.status for r in page} == {"ok"}
        seen += [r.b for r in page]
        kept, cursor = cursor, page[-1].next_cursor
        if cursor is None:
            break
    assert seen == [f"k{i}" for i in range(5)]
    for given, filter_, status in ((kept, "g", "changed"), ("%%%", "f", "invalid"), ("e30=", "f", "invalid")):
        (r,) = evidence.bound_pages(ask(given, filter_), matched, ["a", "b"], 2).collect()
        assert (r.status, r.no, r.b, r.next_cursor) == (status, None, None, None)
