"""Facts derived from the relational tables: one SQL text each, read by Spark here and by the oracle as a CTE."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FACTS: dict[str, str] = {
    "entities": """
SELECT concat('part:', CAST(p_partkey AS STRING)) AS occurrence,
  CASE p_size % 7 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'method' WHEN 3 THEN 'function' WHEN 4 THEN 'enum' WHEN 5 THEN 'route' ELSE 'variable' END AS kind,
  p_name AS name, concat(p_brand, '::', p_name, '#', CAST(p_partkey AS STRING)) AS qualified_name,
  concat('src/', p_brand, '/', CASE WHEN p_size % 9 = 0 THEN 'test_' ELSE '' END, p_type, '_', CAST(p_size % 10 AS STRING), CASE WHEN p_size % 11 = 0 THEN '.pb.go' ELSE '.go' END) AS path,
  CASE p_type WHEN 'ECONOMY' THEN 'go' WHEN 'SMALL' THEN 'java' WHEN 'MEDIUM' THEN 'rust' ELSE 'python' END AS language,
  p_retailprice > 940 AS is_exported, CAST(p_size AS INT) AS line, CAST(p_partkey AS BIGINT) AS ordinal
FROM {part}""",
    "nodes": """
SELECT occurrence, kind, name, qualified_name, path, language, is_exported, line, ordinal FROM {entities}
UNION ALL
SELECT concat('file:', path), 'file', path, path, path, min(language), CAST(NULL AS BOOLEAN), 0, CAST(-1 AS BIGINT) FROM {entities} GROUP BY path""",
    "described": """
SELECT occurrence, kind, name, qualified_name, path, language, line,
  CASE WHEN kind <> 'file' THEN concat(kind, ' ', name, '(', language, ' ', kind, ')') END AS signature,
  CASE WHEN line % 3 = 1 THEN concat('Handles ', language, ' widgets of ', path) END AS documentation FROM {nodes}""",
    "parsed": """
SELECT path, generated, CASE WHEN size % 1700 = 0 THEN 'bad' END AS errors FROM {files}""",
    "edges": """
SELECT concat('e:', CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), ':', CAST(l_partkey AS STRING), ':', CAST(l_suppkey AS STRING)) AS occurrence,
  concat('part:', CAST(prior AS STRING)) AS source, concat('part:', CAST(l_partkey AS STRING)) AS target,
  CASE (l_linenumber + l_suppkey) % 8 WHEN 0 THEN 'calls' WHEN 1 THEN 'references' WHEN 2 THEN 'imports' WHEN 3 THEN 'instantiates' WHEN 4 THEN 'extends' WHEN 5 THEN 'implements' WHEN 6 THEN 'type_of' ELSE 'returns' END AS kind,
  CASE WHEN l_tax = 0 THEN CAST(NULL AS DOUBLE) ELSE 1 - l_discount END AS confidence,
  CASE l_suppkey % 5 WHEN 0 THEN 'import' WHEN 1 THEN 'qualified-name' WHEN 2 THEN 'instance-method' ELSE 'heuristic' END AS reason
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax, l_discount,
  lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS prior FROM {lineitem}) q
WHERE prior IS NOT NULL
UNION ALL
SELECT concat('c:', occurrence), concat('file:', path), occurrence, 'contains', CAST(NULL AS DOUBLE), 'import' FROM {entities}""",
    "files": """
SELECT path, min(language) AS language, CAST(sum(line) * 100 AS BIGINT) AS size, path LIKE '%.pb.go' AS generated, count(*) AS node_count FROM {entities} GROUP BY path""",
    "unresolved": """
SELECT concat('u:', CAST(event_id AS STRING)) AS occurrence, concat('part:', CAST(user_id AS STRING)) AS source, event_type AS name, concat('v', CAST(user_id % 7 AS STRING)) AS name_tail,
  CASE WHEN value > 10 THEN 'calls' ELSE 'function_ref' END AS kind, CAST(event_id AS BIGINT) AS ordinal, CAST(user_id % 50 AS INT) AS line FROM {events}""",
    "requests": """
SELECT CAST(n_nationkey AS INT) AS query_id, concat('part:', CAST(n_nationkey * 7 AS STRING)) AS root, concat('part:', CAST(n_nationkey * 11 + 3 AS STRING)) AS goal FROM {nation}""",
    "repositories": """
SELECT CAST(c_custkey AS BIGINT) AS id, c_mktsegment AS owner, c_name AS name, c_acctbal > 0 AS enabled, c_nationkey = 3 AS archived, CAST(c_nationkey AS BIGINT) AS installation_id,
  CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal < 3000 THEN 'pending' ELSE 'indexed' END AS status FROM {customer}""",
    "snapshots": """
SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS repository_id, o_orderpriority AS stream_key, o_orderdate AS collected_at,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'published' ELSE 'unchanged' END AS outcome, CAST(floor(o_totalprice) % 1000 AS BIGINT) AS digest FROM {orders}""",
    "components": """
SELECT CAST(l_orderkey AS BIGINT) AS snapshot_id, concat(CAST(l_linenumber AS STRING), ':', CAST(l_partkey AS STRING), ':', CAST(l_suppkey AS STRING)) AS element_id,
  p_brand AS ecosystem, p_type AS namespace, p_name AS name, CASE WHEN l_discount = 0.1 THEN CAST(NULL AS STRING) ELSE concat(l_returnflag, CAST(l_linenumber AS STRING)) END AS version,
  CASE WHEN l_tax = 0 THEN CAST(NULL AS STRING) ELSE concat('pkg:', lower(p_type), '/', replace(p_name, ' ', '%20'), '@', l_returnflag, '?arch=x', CAST(p_size AS STRING)) END AS purl,
  CASE p_type WHEN 'ECONOMY' THEN 'MIT' WHEN 'SMALL' THEN 'Apache-2.0 OR GPL-3.0-only' WHEN 'MEDIUM' THEN 'LGPL-2.1-only AND MIT' WHEN 'PROMO' THEN 'NOASSERTION' WHEN 'STANDARD' THEN ' unlicensed ' ELSE CAST(NULL AS STRING) END AS license_raw,
  CASE p_size % 7 WHEN 0 THEN 'resolved' WHEN 1 THEN 'declared' WHEN 2 THEN 'conflict' WHEN 3 THEN 'unlicensed' WHEN 4 THEN 'unknown' ELSE CAST(NULL AS STRING) END AS status,
  l_linenumber = 1 AS is_root, CAST(p_partkey AS BIGINT) AS partkey
FROM {lineitem} l JOIN {part} p ON l_partkey = p_partkey""",
    "decisions": """
SELECT CAST(event_id AS BIGINT) AS id, CAST(user_id AS BIGINT) AS repository_id, event_type AS name, ts AS created_at, ts + INTERVAL 5 DAY AS expires_at,
  CASE WHEN value > 20 THEN 'exception' ELSE 'approval' END AS kind, CAST(floor(value) AS BIGINT) AS fingerprint FROM {events}""",
    "licences": """
SELECT partkey, form, a, b, c, CASE form WHEN 0 THEN a WHEN 1 THEN concat(lower(a), ' or ', b) WHEN 2 THEN concat(a, ' AND ', b) WHEN 3 THEN concat('(', a, ' OR ', b, ') AND ', c) WHEN 4 THEN concat(a, ' OR ', b, ' AND ', c)
  WHEN 5 THEN concat(a, ' WITH Classpath-exception-2.0') WHEN 6 THEN concat('LicenseRef-x AND ', a) WHEN 7 THEN concat('(', a, ' AND ') WHEN 8 THEN 'NOASSERTION' WHEN 9 THEN ' none' END AS expression
FROM (SELECT CAST(p_partkey AS BIGINT) AS partkey, CAST(p_size % 11 AS INT) AS form, PICK(p_partkey) AS a, PICK(p_partkey / 7) AS b, PICK(p_partkey / 49 + p_size) AS c FROM {part}) q""",
    "registry": """
SELECT CAST(p_partkey % 200 AS BIGINT) AS coordinate, CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 3 WHEN 0 THEN 'registry_npm' WHEN 1 THEN 'producer_declared' ELSE 'producer_concluded' END AS source,
  CASE WHEN p_size % 5 < 3 THEN licence END AS licence, CASE p_size % 5 WHEN 0 THEN lower(licence) WHEN 1 THEN concat('(', licence, ')') WHEN 2 THEN concat(licence, ' ') WHEN 3 THEN CASE WHEN p_size % 4 = 0 THEN 'none' ELSE 'NOASSERTION' END END AS license_raw
FROM (SELECT p_partkey, p_size, PICK(p_partkey % 200 + CASE WHEN p_size = 7 THEN 1 ELSE 0 END) AS licence FROM {part}) q WHERE p_partkey % 200 <> 3 OR p_size % 5 > 2""",
    "hits": """
SELECT query_id, occurrence, score, r FROM (SELECT CAST(n_nationkey AS INT) AS query_id, occurrence, CAST((ordinal * 37) % 128 AS DOUBLE) / 8 AS score, row_number() OVER (PARTITION BY n_nationkey ORDER BY (ordinal * 37) % 128 DESC, occurrence) AS r
  FROM {nation} JOIN {entities} ON line % 25 = n_nationkey WHERE ordinal % 3 = 0) q WHERE r <= 20""",
    "terms": """
SELECT CAST(n_nationkey AS INT) AS query_id, CASE k WHEN 0 THEN 'red' WHEN 1 THEN 'bolting' ELSE 'wid' END AS term FROM {nation} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) q""",
    "members": """
SELECT concat('m:', CAST(p_partkey AS STRING)) AS occurrence, concat('part:', CAST((p_partkey * 7919) % (SELECT count(*) FROM {part}) AS STRING)) AS source, concat('part:', CAST(p_partkey AS STRING)) AS target,
  'contains' AS kind, CAST(NULL AS DOUBLE) AS confidence, 'import' AS reason FROM {part}""",
    "corpus": """
SELECT CAST(doc_id AS BIGINT) AS doc_id, source AS repository, concat(source, '/', lang, '/', CAST(doc_id AS STRING), '.txt') AS path, text FROM {documents}""",
}

_LISTED = ("MIT", "Apache-2.0", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "BSD-3-Clause", "Foo")
for _name in ("licences", "registry"):
    FACTS[_name] = re.sub(r"PICK\(([^()]*|[^()]*CASE[^()]*)\)", lambda m: f"CASE CAST(floor({m[1]}) AS BIGINT) % {len(_LISTED)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LISTED)) + " END", FACTS[_name])

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def _needs(sql: str) -> list[str]:
    return [x for x in (*FACTS, *TABLES) if "{" + x + "}" in sql]


class Facts:
    """Facts and tables of one folder as DataFrames, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in FACTS:
                self._made[name] = self.spark.sql(FACTS[name], **{x: getattr(self, x) for x in _needs(FACTS[name])})
            elif name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]


def oracle(sql: str) -> str:
    """SQL with the facts that it names in braces as leading CTEs; joins to its own WITH clause, recursive or not."""
    order: list[str] = []

    def add(text: str) -> None:
        for x in _needs(text):
            if x in FACTS and x not in order:
                add(FACTS[x])
                order.append(x)

    add(sql)
    plain = lambda text: text.format(**{x: x for x in (*FACTS, *TABLES)})
    ctes = [f"{x} AS ({plain(FACTS[x]).strip()})" for x in order]
    body = plain(sql).strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return start + ", ".join([*ctes, body[len(start) :]])
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body
