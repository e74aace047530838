"""Registered queries of ranked discovery, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import discovery as d
from ..operators.graph import GENERATED
from .bindings import Facts
from .graph_queries import register

#: Questions by n_nationkey % 10: text and name that is wanted; then what a reader of the rules takes from them: raw text, kinds,
#: languages, paths, names, terms by word, whole words.
QUESTIONS = (
    ("how is the red bol working in smallWidgets", None, "how is the red bol working in smallwidgets", [], [], [], [], [["red"], ["bol"], ["working", "work", "worke"], ["smallwidgets", "smallwidget", "small", "widgets", "widget"]], ["how", "is", "the", "red", "bol", "working", "in", "smallwidgets"]),
    ("smallWid", None, "smallwid", [], [], [], [], [["smallwid", "small", "wid"]], ["smallwid"]),
    ("kind:class kind:bogus Brand med ring", None, "kind:bogus brand med ring", ["class"], [], [], [], [["kind", "bogus", "bogu"], ["brand"], ["med"], ["ring"]], ["kind:bogus", "brand", "med", "ring"]),
    ("Blue Bolt", "Blue Bolt", "blue bolt", [], [], [], [], [["blue"], ["bolt"]], ["blue", "bolt"]),
    ("src/Brand#4/SMALL_3.go", None, "src/brand#4/small_3.go", [], [], [], [], [["src", "brand", "small", "go"]], ["src/brand#4/small_3.go"]),
    ("redqbolt", None, "redqbolt", [], [], [], [], [["redqbolt"]], ["redqbolt"]),
    ("kind:enum lang:Go", None, "", ["enum"], ["go"], [], [], [], []),
    ("b", None, "b", [], [], [], [], [["b"]], ["b"]),
    ('name:widget path:small_3 "blue wid', None, '"blue wid', [], [], ["small_3"], ["widget"], [["blue"], ["wid"]], ["blue wid"]),
    ("zzqq", None, "zzqq", [], [], [], [], [["zzqq"]], ["zzqq"]),
)


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def _list(value: list, kind: str = "VARCHAR[]") -> str:
    return "CAST([" + ", ".join(_list(v) if isinstance(v, list) else _text(v) for v in value) + f"] AS {kind})"


_READ = ",\n".join(
    f"({k}, {_text(q[2])}, {', '.join(_list(x) for x in q[3:7])}, {_list(q[7], 'VARCHAR[][]')}, {_list(q[8])}, {_list([q[1].lower()] if q[1] else [])})" for k, q in enumerate(QUESTIONS)
)
_RULES = f"""rq AS (SELECT CAST(n_nationkey AS INT) AS query_id, q.* FROM {{nation}} JOIN (VALUES {_READ}) AS q(k, raw, kinds, languages, paths, names, groups, whole, wanted) ON n_nationkey % 10 = k)"""

#: Words of a field, then words cut inside identifiers.
_TERMS = r"""list_concat([w FOR w IN string_split_regex(lower({0}), '[^a-z0-9]+') IF w <> ''],
  [w FOR w IN string_split_regex(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+') IF w <> ''])"""
_POST = (
    "fd AS (SELECT occurrence, f, w, unnest("
    + _TERMS.format("v")
    + """) AS term FROM (
  SELECT occurrence, 1 AS f, 1.0::DOUBLE AS w, name AS v FROM {described} UNION ALL SELECT occurrence, 2, 0.25, qualified_name FROM {described} UNION ALL SELECT occurrence, 3, 0.1, signature FROM {described}
  UNION ALL SELECT occurrence, 4, 0.05, documentation FROM {described} UNION ALL SELECT occurrence, 5, 0.1, path FROM {described}
  UNION ALL SELECT occurrence, 6, 0.05, language FROM {described} UNION ALL SELECT occurrence, 7, 0.05, kind FROM {described}) z WHERE v IS NOT NULL),
ps AS (SELECT occurrence, term, list(w ORDER BY f) AS s, list_distinct(list(f)) AS fs FROM fd GROUP BY ALL),
post AS (SELECT occurrence, term, fs, (list_max(s) + list_sum([s[i] / (i * i) FOR i IN range(1, len(s) + 1)]) - list_max(s) / (list_position(s, list_max(s)) * list_position(s, list_max(s)))) / 1.64493406685 AS weight FROM ps)"""
)
_FACTS = """us AS (SELECT occurrence, count(*) AS usage FROM (SELECT source AS occurrence FROM {edges} WHERE kind NOT IN ('contains', 'imports', 'exports')
  UNION ALL SELECT target FROM {edges} WHERE kind NOT IN ('contains', 'imports', 'exports') AND source <> target) q GROUP BY occurrence),
decl AS (SELECT path, count(*) AS c, count(*) FILTER (kind IN ('interface', 'type_alias', 'enum', 'enum_member', 'namespace')) AS t FROM {described} WHERE kind NOT IN ('file', 'import', 'export', 'parameter') AND path <> '' GROUP BY path),
act AS (SELECT DISTINCT s.path FROM {edges} e JOIN {described} s ON e.source = s.occurrence WHERE e.kind IN ('calls', 'instantiates')),
inc AS (SELECT DISTINCT t.path FROM {edges} e JOIN {described} s ON e.source = s.occurrence JOIN {described} t ON e.target = t.occurrence WHERE s.path <> t.path),
amb AS (SELECT path FROM decl WHERE c = t AND path IN (SELECT path FROM {parsed} WHERE errors IS NULL) AND path NOT IN (SELECT path FROM act) AND path NOT IN (SELECT path FROM inc)),
pj AS (SELECT n.occurrence, n.kind, lower(n.name) AS name, lower(n.qualified_name) AS qualified_name, lower(coalesce(signature, '')) AS signature, lower(coalesce(documentation, '')) AS documentation, lower(n.path) AS path, n.language, coalesce(usage, 0) AS usage,
  n.path LIKE '%.pb.go' OR n.path IN (SELECT path FROM {parsed} WHERE generated) AS generated, n.path IN (SELECT path FROM amb) AS ambient, contains(n.path, '/test_') AS test FROM {described} n LEFT JOIN us USING (occurrence))"""
_RANKED = f"""WITH {_RULES}, {_POST}, {_FACTS},
gt AS (SELECT DISTINCT query_id, g, unnest(groups[g]) AS term FROM (SELECT query_id, groups, unnest(range(1, len(groups) + 1)) AS g FROM rq) z),
nt AS (SELECT query_id, count(DISTINCT term) AS n FROM gt GROUP BY query_id),
mt AS (SELECT query_id, g, gt.term, post.term AS lexeme, occurrence, weight, fs FROM gt JOIN post ON starts_with(post.term, gt.term)),
rk AS (SELECT query_id, occurrence, sum(weight) AS w FROM (SELECT DISTINCT query_id, term, lexeme, occurrence, weight FROM mt) z GROUP BY ALL),
mg AS (SELECT query_id, occurrence, count(DISTINCT g) AS matched, list_distinct(flatten(list(fs))) AS fs FROM mt GROUP BY ALL),
cd AS (SELECT q.*, p.*, coalesce(matched, 0) AS matched, coalesce(w / n, 0) AS rank, coalesce(fs, []) AS fs,
  list_contains(wanted, p.name) OR list_contains(whole, p.name) OR list_contains(whole, p.path) AS says, list_contains(wanted, p.name) AS asked, contains(p.path, 'brand#2/') AS low,
  matched IS NOT NULL OR raw <> '' AND (contains(p.name, raw) OR contains(p.qualified_name, raw) OR contains(p.signature, raw) OR contains(p.documentation, raw) OR contains(p.path, raw)) OR len(groups) = 0 AND raw = '' AS found
  FROM rq q CROSS JOIN pj p LEFT JOIN rk USING (query_id, occurrence) LEFT JOIN mg USING (query_id, occurrence) LEFT JOIN nt USING (query_id)
  WHERE (len(kinds) = 0 OR list_contains(kinds, p.kind)) AND (len(languages) = 0 OR list_contains(languages, p.language))
    AND (len(paths) = 0 OR len([x FOR x IN paths IF contains(p.path, x)]) > 0) AND (len(names) = 0 OR len([x FOR x IN names IF contains(p.name, x)]) > 0)),
hit AS (SELECT *, 0 AS edit_distance, false AS fuzzy FROM cd WHERE found OR says
  UNION ALL SELECT *, levenshtein(name, raw), true FROM cd WHERE length(raw) >= 3 AND query_id NOT IN (SELECT query_id FROM cd WHERE found OR says)
    AND abs(length(name) - length(raw)) <= CASE WHEN length(raw) <= 4 THEN 1 ELSE 2 END AND levenshtein(name, raw) <= CASE WHEN length(raw) <= 4 THEN 1 ELSE 2 END),
sc AS (SELECT query_id, occurrence, fuzzy, CAST(edit_distance AS INT) AS edit_distance, matched, asked OR says AND NOT low AS pinned,
  NOT generated AND NOT ambient AND NOT test AND NOT low AND matched >= 2 AND (usage > 0 OR kind IN ('function', 'method', 'class', 'struct', 'interface', 'trait', 'protocol', 'component', 'route', 'enum', 'type_alias', 'union')) AS corroborated,
  asked OR (asked OR says AND NOT low) AND list_contains(whole, path) OR len(groups) = 0 OR usage > 0 OR kind IN ('function', 'method', 'class', 'struct', 'interface', 'trait', 'protocol', 'component', 'route', 'enum', 'type_alias', 'union') AS entry,
  (asked OR says AND NOT low) AND (asked OR list_contains(whole, name)) AS named,
  concat_ws(',', CASE WHEN fuzzy OR list_contains(fs, 1) OR raw <> '' AND contains(name, raw) THEN 'name' END, CASE WHEN list_contains(fs, 2) OR raw <> '' AND contains(qualified_name, raw) THEN 'qualified_name' END,
    CASE WHEN list_contains(fs, 3) OR raw <> '' AND contains(signature, raw) THEN 'signature' END, CASE WHEN list_contains(fs, 4) OR raw <> '' AND contains(documentation, raw) THEN 'documentation' END,
    CASE WHEN list_contains(fs, 5) OR raw <> '' AND contains(path, raw) THEN 'path' END, CASE WHEN list_contains(kinds, kind) OR list_contains(fs, 7) THEN 'kind' END, CASE WHEN list_contains(languages, language) OR list_contains(fs, 6) THEN 'language' END) AS fields,
  round((1 + 100 * rank + 0.2 * least(usage, 20)) * CASE WHEN says THEN 1 ELSE least(CASE WHEN generated THEN 0.3 ELSE 1 END, CASE WHEN ambient THEN 0.5 ELSE 1 END) * CASE WHEN test THEN 0.5 ELSE 1 END END
    * CASE WHEN low THEN 0.25 ELSE 1 END / (1 + edit_distance) * CASE WHEN kind IN ('variable', 'constant', 'parameter', 'property', 'field', 'enum_member') AND usage = 0 THEN 0.08 WHEN kind IN ('file', 'import', 'export') THEN 0.5 ELSE 1 END, 9)::DOUBLE AS score FROM hit),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, edit_distance, corroborated DESC, score DESC, sha256(occurrence)) AS c FROM sc),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY edit_distance, pinned DESC, corroborated DESC, score DESC, occurrence) AS r FROM cut WHERE c <= 100)"""


def _questions(x: Facts) -> DataFrame:
    asked = x.spark.createDataFrame([(k, q[0], [q[1]] if q[1] else None) for k, q in enumerate(QUESTIONS)], "k int, text string, symbols array<string>")
    return x.nation.select(F.col("n_nationkey").cast("int").alias("query_id"), (F.col("n_nationkey") % 10).cast("int").alias("k")).join(F.broadcast(asked), "k").drop("k")


def _projected(x: Facts) -> DataFrame:
    return d.projection(x.described, x.edges, x.parsed, GENERATED, "/test_")


def _found(x: Facts) -> DataFrame:
    return d.discover(d.durable(_projected(x)), d.durable(d.postings(x.described)), _questions(x), 20, deprioritised=F.col("path").contains("brand#2/"))


register(
    "d1_projection",
    lambda x: _projected(x).select("occurrence", "name", "signature", F.size("grams").alias("grams"), "usage", "generated", "ambient", "test"),
    f"""WITH {_FACTS}, al AS (SELECT *, concat_ws(' ', name, qualified_name, signature, documentation, path) AS v FROM pj)
SELECT occurrence, name, signature, (len(list_distinct(string_split(v, ''))) + len(list_distinct([v[i:i+1] FOR i IN range(1, length(v))])) + len(list_distinct([v[i:i+2] FOR i IN range(1, length(v) - 1)])))::INT AS grams,
  usage, generated, ambient, test FROM al""",
)
register("d1_postings", lambda x: d.postings(x.described).select("term", "occurrence", F.round("weight", 9).alias("weight"), F.bit_count("fields").alias("fields")), f"WITH {_POST} SELECT term, occurrence, round(weight, 9) AS weight, len(fs)::INT AS fields FROM post")
register(
    "d2_filters",
    lambda x: d.parse(_questions(x)).select("query_id", F.lower("text").alias("text"), *[F.array_join(c, "|").alias(c) for c in ("kinds", "languages", "paths", "names")]),
    f"WITH {_RULES} SELECT query_id, raw AS text, array_to_string(kinds, '|') AS kinds, array_to_string(languages, '|') AS languages, array_to_string(paths, '|') AS paths, array_to_string(names, '|') AS names FROM rq",
)
register(
    "d3_discover",
    lambda x: _found(x).select("query_id", "occurrence", "r", "pinned", "fuzzy", "edit_distance", "corroborated", "matched", F.array_join("fields", ",").alias("fields"), F.round("score", 6).alias("score")),
    _RANKED + " SELECT query_id, occurrence, CAST(r AS INT) AS r, pinned, fuzzy, edit_distance, corroborated, matched, fields, round(score, 6) AS score FROM top WHERE r <= 20",
)
register(
    "d8_confidence",
    lambda x: d.confidence(_questions(x), _found(x)),
    _RANKED
    + """ SELECT query_id, CASE WHEN coalesce(e, false) OR coalesce(m, false) OR k = 7 AND e IS NOT NULL THEN 'candidates' ELSE 'no_entry_point' END AS status, CASE WHEN e AND k <> 7 THEN 'discovery_only' ELSE 'low' END AS confidence
FROM rq LEFT JOIN (SELECT query_id, bool_or(entry) AS e, bool_or(named) AS m FROM top WHERE r <= 20 GROUP BY query_id) z USING (query_id)""",
)
_TYPO = "SELECT occurrence AS query_id, concat(left(lower(name), 2), 'x', substr(lower(name), 4)) AS text FROM {nodes} WHERE ordinal % 40 = 0"
register(
    "d4_fuzzy",
    lambda x: d.fuzzy(x.nodes.select("occurrence", F.lower("name").alias("name")), x.spark.sql(_TYPO.replace("left(", "substr(").replace(", 2), 'x'", ", 1, 2), 'x'"), nodes=x.nodes)),
    f"SELECT query_id, occurrence, levenshtein(text, lower(name))::INT AS edit_distance FROM ({_TYPO}) q, {{nodes}} WHERE length(text) >= 3 AND levenshtein(text, lower(name)) <= CASE WHEN length(text) <= 4 THEN 1 ELSE 2 END",
)
register(
    "d5_terms",
    lambda x: d.plan(_questions(x)).select("query_id", "raw", F.array_join(F.transform("groups", lambda g: F.array_join(g, " ")), "|").alias("terms"), F.array_join("symbols", "|").alias("symbols")),
    f"WITH {_RULES} SELECT query_id, raw, array_to_string([array_to_string(g, ' ') FOR g IN groups], '|') AS terms, array_to_string(list_concat(wanted, whole), '|') AS symbols FROM rq",
)
_FORMS = "SELECT DISTINCT concat(w, e) AS word FROM (SELECT regexp_replace(lower(p_name), '[^a-z]', '{g}') AS w FROM {{part}}) a CROSS JOIN (SELECT 'ing' AS e UNION ALL SELECT 'ning' UNION ALL SELECT 'tion' UNION ALL SELECT 'sion' UNION ALL SELECT 'ment' UNION ALL SELECT 'ies' UNION ALL SELECT 'es' UNION ALL SELECT 's' UNION ALL SELECT 'ss' UNION ALL SELECT 'ed' UNION ALL SELECT 'eed' UNION ALL SELECT 'er' UNION ALL SELECT 'tter' UNION ALL SELECT '') b"
register(
    "d5_variants",
    lambda x: x.spark.sql(_FORMS.replace("', '{g}')", "', '')").replace("{{part}}", "{part}"), part=x.part).select("word", F.array_join(F.array_sort(d.variants(F.col("word"))), " ").alias("variants")),
    f"""WITH f AS ({_FORMS.replace("'{g}')", "'', 'g')").replace("{{part}}", "{part}")}), v AS (SELECT word, left(word, -1) AS one, left(word, -2) AS two, left(word, -3) AS three, left(word, -4) AS four, length(word) AS n FROM f)
SELECT word, array_to_string(list_sort(list_distinct(list_filter([word,
  CASE WHEN word LIKE '%ing' AND n > 5 THEN three END, CASE WHEN word LIKE '%ing' AND n > 5 THEN concat(three, 'e') END, CASE WHEN word LIKE '%ing' AND n > 5 AND right(three, 1) = right(four, 1) THEN four END,
  CASE WHEN (word LIKE '%tion' OR word LIKE '%sion') AND n > 5 THEN three END, CASE WHEN word LIKE '%ment' AND n > 6 THEN four END,
  CASE WHEN word LIKE '%ies' AND n > 4 THEN concat(three, 'y') WHEN word LIKE '%es' AND n > 4 THEN two WHEN word LIKE '%s' AND word NOT LIKE '%ss' AND n > 4 THEN one END, CASE WHEN word LIKE '%es' AND NOT word LIKE '%ies' AND n > 4 THEN one END,
  CASE WHEN word LIKE '%ed' AND word NOT LIKE '%eed' AND n > 4 THEN one END, CASE WHEN word LIKE '%ed' AND word NOT LIKE '%eed' AND n > 4 THEN two END,
  CASE WHEN word LIKE '%er' AND n > 4 THEN two END, CASE WHEN word LIKE '%er' AND n > 4 THEN concat(two, 'e') END, CASE WHEN word LIKE '%er' AND n > 4 AND right(two, 1) = right(three, 1) THEN three END],
  lambda e: e = word OR length(e) >= 3))), ' ') AS variants FROM v""",
)
