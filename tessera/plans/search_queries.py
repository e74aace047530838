"""Registered queries of code search for tables of requests, and of discovery, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import codeindex as ci
from ..operators import search as s
from ..shipping import scratch
from .bindings import Facts
from .graph_queries import register


def _sql(x: Facts, text: str, *tables: str) -> DataFrame:
    return x.spark.sql(text, **{k: getattr(x, k) for k in tables})


_ASK = """SELECT CAST(n_nationkey AS INT) AS query_id, CASE n_nationkey % 6 WHEN 0 THEN 'the and' WHEN 1 THEN '"er the" file:/en/' WHEN 2 THEN 'The case:yes' WHEN 3 THEN '(?i)x' WHEN 4 THEN concat('file:', '[.]txt$') ELSE concat(lower(substring(n_name, 1, 2)), ' case:no') END AS text FROM {nation}"""
register("c1_parsed_requests", lambda x: s.parse_requests(_sql(x, _ASK, "nation")).select("query_id", F.array_join("terms", "|").alias("terms"), F.array_join("files", "|").alias("files"), "case", "problem"), """SELECT n_nationkey::INT AS query_id, CASE n_nationkey % 6 WHEN 0 THEN 'the|and' WHEN 1 THEN 'er the' WHEN 2 THEN 'The' WHEN 3 THEN '(?i)x' WHEN 4 THEN '' ELSE lower(substring(n_name, 1, 2)) END AS terms,
CASE n_nationkey % 6 WHEN 1 THEN '/en/' WHEN 4 THEN '[.]txt$' ELSE '' END AS files, n_nationkey % 6 = 2 AS "case", CASE n_nationkey % 6 WHEN 3 THEN 'inline_flag' END AS problem FROM {nation}""")
_HITS = """WITH q AS (SELECT n_nationkey::INT AS query_id, n_nationkey % 6 AS k, lower(substring(n_name, 1, 2)) AS two FROM {nation} WHERE n_nationkey % 6 NOT IN (3, 4)), li AS (SELECT repository, path, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM (SELECT repository, path, string_split(text, chr(10)) AS parts FROM {corpus} [scope]) z),
n AS (SELECT query_id, repository, path, line_no, CASE k WHEN 0 THEN CASE WHEN contains(lower(line), 'the') AND contains(lower(line), 'and') THEN (length(lower(line)) - length(replace(lower(line), 'the', ''))) // 3 + (length(lower(line)) - length(replace(lower(line), 'and', ''))) // 3 END
WHEN 1 THEN CASE WHEN contains(path, '/en/') THEN (length(lower(line)) - length(replace(lower(line), 'er the', ''))) // 6 END WHEN 2 THEN (length(line) - length(replace(line, 'The', ''))) // 3 ELSE (length(lower(line)) - length(replace(lower(line), two, ''))) // 2 END::INT AS score FROM q, li),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repository, path, line_no) AS no, count(*) OVER (PARTITION BY query_id) > 15 AS truncated FROM n WHERE score > 0) SELECT query_id, repository, path, line_no, score, no, truncated FROM b WHERE no <= 15"""
register("c6_bounded_requests", lambda x: s.search_requests(x.corpus, _sql(x, _ASK, "nation"), 0, 15).drop("preview"), _HITS.replace("[scope]", ""))
register("c3_scoped_requests", lambda x: s.search_requests(x.corpus, _sql(x, _ASK, "nation"), 0, 15, x.corpus.select("repository").distinct().filter("repository < 'src15'")).drop("preview"), _HITS.replace("[scope]", "WHERE repository < 'src15'"))
register("c3_empty_scope", lambda x: s.search_requests(x.corpus, _sql(x, _ASK, "nation"), 0, 15, x.corpus.select("repository").limit(0)).groupBy().agg(F.count("*").alias("n")), "SELECT CAST(0 AS BIGINT) AS n")
register("c2_path_search", lambda x: s.path_search(x.corpus, x.nation.selectExpr("CAST(n_nationkey AS INT) AS query_id", "concat('/de/.*', n_nationkey, '[.]txt$') AS pattern")), "SELECT n_nationkey::INT AS query_id, repository, path FROM {corpus}, {nation} WHERE regexp_matches(path, concat('/de/.*', n_nationkey, '[.]txt$'))")

#: Requests of an indexed search by n_nationkey % 10: pattern, whether it is a regular expression, case.
_PATTERNS = (
    ("anol", False, False), ("The", False, True), ("th[aeiou]t", True, False), ("(?:ing|tion)[ ,.]+(?:the|and) ", True, False), ("[A-Z]n.*erk", True, True),
    ("q", False, False), ("lich(?:keit)+ü?", True, False), ("ü[a-z]+ß|œuvre|xyzzyq", True, False), ("^In .*in\\\\.$", True, True), ("ment.{0,12}tion", True, False),
)


def _asks(x: Facts) -> DataFrame:
    rows = [(k, f"{p}{' case:yes' if case else ''}" if " " not in p else f'"{p}"{" case:yes" if case else ""}', regex) for k, (p, regex, case) in enumerate(_PATTERNS)]
    asked = x.spark.createDataFrame(rows, "k int, text string, regex boolean")
    return x.nation.select(F.col("n_nationkey").cast("int").alias("query_id"), (F.col("n_nationkey") % 10).cast("int").alias("k")).join(F.broadcast(asked), "k").drop("k")


def _indexed(x: Facts) -> ci.Index:
    folder = scratch(x.spark, "index")
    ci.write_index(x.corpus, folder)
    return ci.read_index(x.spark, folder)


_ASKED = "VALUES " + ", ".join(f"({k}, '{p}', {str(regex).lower()}, {str(case).lower()})" for k, (p, regex, case) in enumerate(_PATTERNS))
register(
    "c1_indexed_search",
    lambda x: ci.search(_indexed(x), _asks(x), 1, 40),
    f"""WITH q AS (SELECT n_nationkey::INT AS query_id, v.* FROM {{nation}} JOIN ({_ASKED.replace("{", "{{").replace("}", "}}")}) AS v(k, pattern, regex, cased) ON n_nationkey % 10 = k),
li AS (SELECT repository, path, parts, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM (SELECT repository, path, string_split(text, chr(10)) AS parts FROM {{corpus}}) z),
m AS (SELECT query_id, repository, path, line_no, array_to_string(parts[greatest(line_no - 1, 1):line_no + 1], chr(10)) AS preview FROM q JOIN li
  ON CASE WHEN regex AND cased THEN regexp_matches(line, pattern) WHEN regex THEN regexp_matches(line, pattern, 'i') WHEN cased THEN contains(line, pattern) ELSE contains(lower(line), lower(pattern)) END),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY repository, path, line_no) AS no, count(*) OVER (PARTITION BY query_id) > 40 AS truncated FROM m)
SELECT query_id, repository, path, CAST(line_no AS INT) AS line_no, preview, CAST(no AS INT) AS no, truncated FROM n WHERE no <= 40""",
)
_MATCH = "SELECT c_custkey AS id, concat('r', CAST(c_custkey % 40 AS STRING)) AS repository, concat('sha', CAST(c_custkey % 3 AS STRING)) AS commit, split(CASE c_custkey % 4 WHEN 0 THEN 'main,dev' WHEN 1 THEN 'dev' ELSE 'trunk,main' END, ',') AS branches FROM {customer}"
_REPO = "SELECT concat('r', CAST(k AS STRING)) AS name, concat('sha', CAST(k % 3 AS STRING)) AS indexed_sha, CASE k % 2 WHEN 0 THEN 'main' ELSE 'dev' END AS default_branch FROM (SELECT DISTINCT c_custkey % 40 AS k FROM {customer}) q"
register("c5_consistent", lambda x: s.consistent(_sql(x, _MATCH, "customer"), _sql(x, _REPO, "customer")).select("id", "repository"), f"WITH m AS ({_MATCH}), r AS ({_REPO}) SELECT id, repository FROM m JOIN r ON name = repository AND indexed_sha = m.commit WHERE list_contains(branches, default_branch)")

_SEG = "[s FOR s IN string_split(lower(regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' ') IF length(s) >= 2]"
_STOPPED = "[s FOR s IN " + _SEG.format("text") + " IF s NOT IN ('a', 'an', 'and', 'are', 'by', 'do', 'does', 'for', 'from', 'how', 'in', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'what', 'when', 'where', 'which', 'with')]"
register("d7_segments", lambda x: s.segment_vocabulary(x.nodes), f"SELECT segment, count(*) AS names FROM (SELECT DISTINCT name, unnest({_SEG.format('name')}[1:12]) AS segment FROM {{nodes}}) q WHERE length(segment) <= 32 GROUP BY segment")
_WORDS = "SELECT CAST(n_nationkey AS INT) AS query_id, CASE n_nationkey % 3 WHEN 0 THEN 'the reds bolts' WHEN 1 THEN concat('medium', CAST(n_nationkey AS STRING)) ELSE concat('brand', CAST(n_nationkey AS STRING), ' small') END AS text FROM {nation}"
register("d7_matches", lambda x: s.segment_matches(x.nodes, _sql(x, _WORDS, "nation"), (2, 100000)), f"""WITH q AS ({_WORDS}), w AS (SELECT DISTINCT query_id, unnest({_STOPPED}) AS word FROM q), v AS (SELECT DISTINCT query_id, word, unnest(list_filter([word, concat(word, 's'), CASE WHEN word LIKE '%s' AND length(word) > 3 THEN left(word, -1) END], lambda e: e IS NOT NULL)) AS segment FROM w),
h AS (SELECT DISTINCT name, unnest({_SEG.format('name')}[1:12]) AS segment FROM {{nodes}}), n AS (SELECT segment, count(*) AS names FROM h GROUP BY 1), b AS (SELECT query_id, name, count(DISTINCT word) AS words, bool_or(names BETWEEN 2 AND 100000 AND length(word) >= 5) AS rare FROM v JOIN h USING (segment) JOIN n USING (segment) GROUP BY 1, 2),
t AS (SELECT *, max(words) OVER (PARTITION BY query_id) >= 2 AS has FROM b) SELECT query_id, name, CASE WHEN words >= 2 THEN 'A' ELSE 'B' END AS tier, words FROM t WHERE words >= 2 OR NOT has AND rare""")
_MANIFEST = """SELECT concat('team/', replace(c_name, '#', '')) AS repository, CASE c_custkey % 4 WHEN 0 THEN 'go.mod' WHEN 1 THEN 'web/package.json' WHEN 2 THEN 'Cargo.toml' ELSE 'README' END AS path, CASE c_custkey % 4 WHEN 0 THEN concat('// x', chr(10), 'module example.org/Mod', CAST(c_custkey AS STRING), chr(10)) WHEN 1 THEN concat('{{"name":"@s/pkg-', CAST(c_custkey AS STRING), '"}}') WHEN 2 THEN concat('[package]', chr(10), 'name = "cr', CAST(c_custkey AS STRING), '"') ELSE 'name' END AS body FROM {customer}"""
_TERMS = "SELECT c_custkey AS query_id, concat('team/', replace(c_name, '#', '')) AS repository, CASE c_custkey % 3 WHEN 0 THEN concat('mod', CAST(c_custkey AS STRING)) WHEN 1 THEN concat('pkg', CAST(c_custkey AS STRING)) ELSE 'other' END AS term FROM {customer}"
_PT = f"WITH m AS ({_MANIFEST}), pt AS (SELECT repository, regexp_replace(lower(regexp_extract(repository, '[^/]*$')), '[^a-z0-9]', '', 'g') AS term FROM m UNION SELECT repository, CASE path WHEN 'go.mod' THEN lower(regexp_extract(body, 'Mod[0-9]+')) WHEN 'web/package.json' THEN replace(regexp_extract(body, 'pkg-[0-9]+'), '-', '') WHEN 'Cargo.toml' THEN regexp_extract(body, 'cr[0-9]+') END FROM m)"
register("d9_project_terms", lambda x: s.project_terms(_sql(x, _MANIFEST, "customer"), _sql(x, _MANIFEST, "customer").select(F.col("repository").alias("name")).distinct()), _PT + " SELECT DISTINCT repository, term FROM pt WHERE length(term) >= 5")
register("d9_terms_left", lambda x: s.without_project_terms(_sql(x, _TERMS, "customer"), s.project_terms(_sql(x, _MANIFEST, "customer"), _sql(x, _MANIFEST, "customer").select(F.col("repository").alias("name")).distinct())), _PT + f", t AS ({_TERMS}) SELECT query_id, repository, term FROM t WHERE (repository, term) NOT IN (SELECT repository, term FROM pt WHERE length(term) >= 5)")
