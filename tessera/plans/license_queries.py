"""Registered queries over licence expressions, policies and assessments, each with its SQL.

The SQL states what each form of expression in the fact `licences` must come to, from its three operands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as e
from ..operators import portfolio as p
from ..operators import review as r
from .bindings import Facts
from .graph_queries import register
from .supply_queries import _LATEST, _latest

RULES = {"approved": ["MIT", "Apache-2.0", "BSD-3-Clause"], "review_required": ["LGPL-2.1-only"], "prohibited": ["GPL-3.0-only"]}


def _licensed(x: Facts) -> DataFrame:
    """Components whose licence text is that of their part."""
    return x.components.drop("license_raw").join(x.licences.select("partkey", F.col("expression").alias("license_raw")), "partkey")


_UNKNOWN = "(a = 'Foo' OR form IN (1, 2, 3, 4) AND b = 'Foo' OR form IN (3, 4) AND c = 'Foo')"
_TEXT = "CASE form WHEN 1 THEN concat(CASE a WHEN 'Foo' THEN 'foo' ELSE a END, ' OR ', b) WHEN 7 THEN NULL WHEN 8 THEN NULL WHEN 9 THEN NULL ELSE expression END"
register(
    "l2_expressions",
    lambda x: e.normalise(x.licences.select("partkey", "expression").withColumnRenamed("expression", "raw"), "raw").select("partkey", "expression_status", "expression", F.array_join("unknown_terms", ",").alias("unknown_terms"), F.array_join("license_references", ",").alias("license_references"), F.size("expression_terms").alias("terms")),
    f"""SELECT partkey, CASE WHEN form = 7 THEN 'invalid' WHEN form = 9 THEN 'none' WHEN form IN (8, 10) THEN 'no_assertion' WHEN {_UNKNOWN} THEN 'unknown_terms' ELSE 'parsed' END AS expression_status, {_TEXT} AS expression,
CASE WHEN form < 7 AND {_UNKNOWN} THEN array_to_string(list_sort(list_distinct(list_concat(CASE WHEN a = 'Foo' THEN [CASE form WHEN 1 THEN 'foo' WHEN 5 THEN 'Foo WITH Classpath-exception-2.0' ELSE 'Foo' END] ELSE [] END, CASE WHEN form IN (1, 2, 3, 4) AND b = 'Foo' OR form IN (3, 4) AND c = 'Foo' THEN ['Foo'] ELSE [] END))), ',') ELSE '' END AS unknown_terms,
CASE form WHEN 6 THEN 'LicenseRef-x' ELSE '' END AS license_references,
CASE WHEN form > 6 THEN 0 WHEN form IN (0, 5) THEN 1 WHEN form = 6 THEN 2 WHEN form = 1 THEN len(list_distinct([CASE a WHEN 'Foo' THEN 'foo' ELSE a END, b])) WHEN form = 2 THEN len(list_distinct([a, b])) ELSE len(list_distinct([a, b, c])) END AS terms FROM {{licences}}""",
)
_SEV = "CASE {0} WHEN 'MIT' THEN 0 WHEN 'Apache-2.0' THEN 0 WHEN 'BSD-3-Clause' THEN 0 WHEN 'LGPL-2.1-only' THEN 1 WHEN 'GPL-3.0-only' THEN 3 ELSE 2 END"
_A, _B, _C = (_SEV.format(x) for x in "abc")
_VERDICT = f"list_extract(['approved', 'review_required', 'unknown', 'prohibited'], 1 + CASE form WHEN 0 THEN {_A} WHEN 1 THEN least({_A}, {_B}) WHEN 2 THEN greatest({_A}, {_B}) WHEN 3 THEN greatest(least({_A}, {_B}), {_C}) WHEN 4 THEN least({_A}, greatest({_B}, {_C})) WHEN 5 THEN CASE a WHEN 'Foo' THEN 2 ELSE 1 END WHEN 6 THEN greatest(2, {_A}) ELSE 2 END)"
register("r1_verdicts", lambda x: e.verdicts(x.licences.select("partkey", "expression"), "expression", e.Policy(RULES)).select("partkey", "verdict", F.size("acceptable").alias("branches")), f"SELECT partkey, {_VERDICT} AS verdict, CASE form WHEN 1 THEN ({_A} = 0)::INT + ({_B} = 0)::INT WHEN 4 THEN ({_A} = 0)::INT + (greatest({_B}, {_C}) = 0)::INT ELSE 0 END AS branches FROM {{licences}}")
register(
    "r2_rule_problems",
    lambda x: r.rule_problems(x.licences.select((F.col("partkey") % 40).alias("policy_id"), F.when(F.col("form") % 2 == 0, "approved").otherwise("prohibited").alias("class"), F.col("expression").alias("term")).filter("term IS NOT NULL")),
    """WITH t AS (SELECT DISTINCT partkey % 40 AS policy_id, CASE form % 2 WHEN 0 THEN 'approved' ELSE 'prohibited' END AS class, expression AS term, CASE WHEN form = 0 AND a <> 'Foo' THEN lower(a) WHEN form = 5 AND a <> 'Foo' THEN lower(expression) END AS k FROM {licences} WHERE expression IS NOT NULL)
SELECT policy_id, class, term, 'not_a_term' AS problem FROM t WHERE k IS NULL UNION ALL SELECT policy_id, class, term, 'several_classes' FROM t WHERE k IN (SELECT u.k FROM t u WHERE u.policy_id = t.policy_id AND u.class <> t.class)""",
)
_BY = f"CASE WHEN partkey % 5 < 2 THEN {_VERDICT} WHEN partkey % 5 = 2 THEN 'review_required' WHEN partkey % 5 = 3 THEN 'prohibited' ELSE 'unknown' END"
_STATUS = lambda: F.element_at(F.array(*map(F.lit, ("resolved", "declared", "conflict", "unlicensed", "pending"))), (F.col("partkey") % 5 + 1).cast("int"))
register("r3_verdict_by_status", lambda x: r.verdict_by_status(x.licences.select("partkey", "expression").withColumn("status", _STATUS()), e.Policy(RULES)).select("partkey", "verdict"), f"SELECT partkey, {_BY} AS verdict FROM {{licences}}")
_STRICT = "CASE {0} WHEN 'MIT' THEN 0 WHEN 'Apache-2.0' THEN 0 WHEN 'BSD-3-Clause' THEN 0 WHEN 'Foo' THEN 2 WHEN 'GPL-3.0-only' THEN 4 ELSE 3 END"
_A, _B, _C = (_STRICT.format(x) for x in "abc")
_FAMILY = f"list_extract(['permissive', 'unknown', 'other', 'weak_copyleft', 'strong_copyleft'], 1 + CASE form WHEN 0 THEN {_A} WHEN 1 THEN greatest({_A}, {_B}) WHEN 2 THEN greatest({_A}, {_B}) WHEN 3 THEN greatest({_A}, {_B}, {_C}) WHEN 4 THEN greatest({_A}, {_B}, {_C}) WHEN 5 THEN {_A} WHEN 6 THEN greatest({_A}, 2) WHEN 7 THEN {_A} ELSE 1 END)"
register("p18_families", lambda x: x.licences.select("partkey", e.family(F.col("expression")).alias("family")), f"SELECT partkey, {_FAMILY} AS family FROM {{licences}}")
register(
    "p19_license_mix",
    lambda x: p.license_mix(_licensed(x), _latest(x), 3).select("repository_id", "family", "n", "licensed", F.array_join(F.transform("expressions", lambda y: F.concat_ws(" x", F.coalesce(y["expression"], F.lit("?")), y["n"].cast("string"))), "; ").alias("expressions")),
    f"""WITH {_LATEST}, g AS (SELECT repository_id, {_FAMILY} AS family, expression, count(*) AS n FROM {{components}} JOIN latest USING (snapshot_id) JOIN {{licences}} USING (partkey) GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY repository_id, family ORDER BY n DESC, coalesce(expression, '')) AS r FROM g)
SELECT repository_id, family, sum(n)::BIGINT AS n, sum(CASE WHEN trim(expression) <> '' THEN n ELSE 0 END)::BIGINT AS licensed, string_agg(concat(coalesce(expression, '?'), ' x', n), '; ' ORDER BY r) FILTER (r <= 3) AS expressions FROM k GROUP BY repository_id, family""",
)
_ASSESSED = """SELECT coordinate, CASE WHEN k > 1 OR k = 1 AND refused THEN 'conflict' WHEN k = 1 THEN CASE WHEN backed THEN 'resolved' ELSE 'declared' END WHEN refused THEN 'unlicensed' ELSE 'unknown' END AS status, CASE WHEN k = 1 AND NOT refused THEN one END AS expression, k > 1 OR k = 1 AND refused AS detailed
FROM (SELECT coordinate, count(DISTINCT t) AS k, min(t) AS one, bool_or(coalesce(license_raw = 'none', false)) AS refused, bool_or(t IS NOT NULL AND source = 'registry_npm') AS backed FROM (SELECT *, CASE WHEN licence = 'Foo' AND license_raw = 'foo' THEN 'foo' ELSE licence END AS t FROM {registry}) q GROUP BY coordinate) w"""
register("l11_assess", lambda x: r.assess(x.registry, ["coordinate"]).select("coordinate", "status", "expression", F.col("detail").isNotNull().alias("detailed")), _ASSESSED)
register("t7_reassess", lambda x: r.reassess(x.registry, x.registry.filter("id % 17 = 0").select("coordinate"), ["coordinate"]).select("coordinate", "status"), f"SELECT coordinate, status FROM ({_ASSESSED}) z WHERE coordinate IN (SELECT coordinate FROM {{registry}} WHERE id % 17 = 0)")
