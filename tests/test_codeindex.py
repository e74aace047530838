"""The trigram index: what patterns need, equality with a scan, few texts read, previews of long texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import codeindex as ci
from tessera.operators import search as s


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("foobar", [["foobar"]]), ("foo.*bar", [["foo"], ["bar"]]), ("foo|barn", [["foo", "barn"]]), ("(foo|ba?rn)x", [["foo", "rn"], ["x"]]), ("a(bc)+d", [["a"], ["bc"], ["d"]]), ("a(bc)*d", [["a"], ["d"]]),
        ("a(?:bcd)e", [["abcde"]]), (r"\bfoo\b", [["foo"]]), ("^foo$", [["foo"]]), ("fo{2}", [["f"], ["o"]]), ("x[ab]y", [["x"], ["y"]]), ("foo?", [["fo"]]), ("(?i)foo", []), ("(?x) foo", []), (r"\p{L}foo", []), ("(foo", []), ("foo||", []), (".", []), ("(?i:foo)bar", [["bar"]]),
    ],
)
def test_needs(pattern, want):
    assert ci.needs(pattern) == want


def test_needs_are_needed():
    """Whatever fits a pattern has one string of each list."""
    rng = random.Random(1)
    patterns = ["ab+c", "(ab|ca)c", "a(b|cc)*ab", "[ab]cab?", "(abc|bca){2}", "a.b.c", "(?:ab){2,}c", "c(?=ab)a"]
    for p in patterns:
        for _ in range(3000):
            text = "".join(rng.choice("abc") for _ in range(10))
            if re.search(p, text):
                assert all(any(x in text for x in c) for c in ci.needs(p)), (p, text)


def test_trigrams():
    assert len(ci.trigrams("ab")) == 0 and list(ci.trigrams("ABCabc")) == list(ci.trigrams("abcABC")) and len(ci.trigrams("aaaa")) == 1
    assert set(ci.trigrams("x\U0001f600yÄ")) >= set(ci.trigrams("\U0001f600yÄ")) and list(ci.trigrams("Äbc")) != list(ci.trigrams("äbc"))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgÄß") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    rows = [(f"r{n % 7}", f"d{n % 5}/f{n}.go", "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30)))) for n in range(300)]
    rows += [("r1", "needle.go", "first line\nHere lies the Needle-7\nlast"), ("r2", "none.go", None), ("r2", "empty.go", ""), ("r3", "twin.go", "xyz\nxyz\nxyz")]
    return spark.createDataFrame(rows, "repository string, path string, text string"), rows


def test_index_equals_scan(spark, corpus, tmp_path_factory):
    df, rows = corpus
    ci.write_index(df, str(tmp_path_factory.mktemp("index")) + "/i")
    index = ci.read_index(spark, str(tmp_path_factory.getbasetemp() / "index0" / "i"))
    asks = [(0, "needle-[0-9]", True), (1, "ab", False), (2, "a[bc]d.*fe", True), (3, '"first line"', False), (4, "needle case:yes", False), (5, "x+y?z", True), (6, "Ä.*ß", True), (7, "ab cd file:d1/", False), (8, "(?i)x", True), (9, "(abc|bcd|dda)e?", True), (10, "äb", False), (11, "zzzzzz", False)]
    req = spark.createDataFrame(asks, "query_id int, text string, regex boolean")
    got = ci.search(index, req, 1, 10_000).collect()
    for q, text, regex in asks[:8] + asks[9:]:
        case = "case:yes" in text
        pattern, file = re.sub(r" ?case:yes| ?file:\S+", "", text), "d1/" if "file:" in text else ""
        terms = [pattern.strip('"')] if '"' in pattern or regex else pattern.split()
        want = set()
        for repo, path, body in rows:
            for no, line in enumerate((body or "").split("\n") if body is not None else []):
                each = [re.search(t if regex else re.escape(t), line, 0 if case else (re.I | re.A if regex else re.I)) for t in terms]
                if all(each) and file in path:
                    want.add((repo, path, no + 1))
        assert {(r.repository, r.path, r.line_no) for r in got if r.query_id == q} == want, text
    assert not [r for r in got if r.query_id == 8]
    (needle,) = [r for r in got if r.query_id == 4 or r.query_id == 0 and r.path == "needle.go"][:1]
    assert needle.preview == "first line\nHere lies the Needle-7\nlast"
    # one file has what the first request needs, and only its folder is read
    asked = s.parse_requests(req).join(req.select("query_id", "regex"), "query_id").filter("query_id IN (0, 11)").select("query_id", "terms", "files", "case", "regex")
    assert ci.candidates(index, asked).count() == 1


def test_truncation_counts(spark):
    rows = [(q, i) for q in (1, 2) for i in range(30 if q == 1 else 5)]
    got = s.bounded(spark.createDataFrame(rows, "query_id int, x int"), ["x"], 5).collect()
    assert sorted((r.query_id, r.no, r.truncated) for r in got) == [(1, n, True) for n in range(1, 6)] + [(2, n, False) for n in range(1, 6)]
    plan = s.bounded(spark.createDataFrame(rows, "query_id int, x int"), ["x"], 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_previews_are_linear_in_the_text(spark):
    def took(kb):
        text = "\n".join(f"line {i} with words" for i in range(kb * 48))
        df = spark.createDataFrame([("r", "p", text)], "repository string, path string, text string")
        began = time.time()
        n = s.search(df, "words", context=3).agg(F.sum(F.length("preview"))).first()
        assert n is not None
        return time.time() - began

    took(50)
    small, large = took(250), took(2000)
    assert large < 12 * small + 2
