"""Registered queries over SBOM documents, stored facts and the portfolio, each with its SQL.

Documents are built from the components of each snapshot in both formats, with ids left out, nested parts, unknown ends and
odd licences by rule, so that the SQL can say what reading them must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import portfolio as p
from ..operators import traverse as t
from ..shipping import shared_dir, tidy, written
from ..sources import cyclonedx as cdx
from ..sources import facts as fx
from ..sources import purl as pu
from ..sources import sbom
from .bindings import Facts
from .graph_queries import register
from .supply_queries import _LATEST, _REPOS, NOW, _latest

_ROOTS = "rt AS (SELECT snapshot_id, min(element_id) AS root_element FROM {components} WHERE is_root GROUP BY snapshot_id)"


def _cdx_bodies(x: Facts) -> DataFrame:
    roots = x.components.filter("is_root").groupBy("snapshot_id").agg(F.min("element_id").alias("root_element"))
    c = x.components.join(roots, "snapshot_id", "left").withColumn("top", F.col("element_id") == F.col("root_element"))
    licence = F.when(F.col("partkey") % 4 == 0, F.array(F.struct(F.lit(None).cast("string").alias("expression"), F.struct(F.lit("MIT").alias("id")).alias("license")))).when(F.col("partkey") % 4 == 1, F.array(F.struct(F.lit("MIT OR ISC").alias("expression"), F.struct(F.lit(None).cast("string").alias("id")).alias("license"))))
    licence = licence.when(F.col("partkey") % 4 == 2, F.transform(F.array(F.lit("MIT"), F.lit("Apache-2.0")), lambda i: F.struct(F.lit(None).cast("string").alias("expression"), F.struct(i.alias("id")).alias("license"))))
    comp = F.struct(F.when(F.col("partkey") % 7 != 0, F.col("element_id")).alias("bom-ref"), F.when(F.col("partkey") % 6 == 0, "firmware").otherwise("library").alias("type"), "name", "version", "purl", licence.alias("licenses"))
    c = c.withColumn("comp", comp).withColumn("nested", F.col("root_element").isNotNull() & (F.col("partkey") % 5 == 0))
    of = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.struct("element_id", "comp"))))
    by = c.groupBy(F.col("snapshot_id").alias("document_id")).agg(F.first("root_element", ignorenulls=True).alias("root"), F.first(F.when(F.col("top"), F.col("comp")), ignorenulls=True).alias("rc"), of(F.col("nested") & ~F.coalesce("top", F.lit(False))).alias("inner"), of(~F.col("nested") & ~F.coalesce("top", F.lit(False))).alias("outer"), F.sort_array(F.collect_list(F.when(~F.coalesce("top", F.lit(False)), F.col("element_id")))).alias("rest"))
    ghost = F.when(F.col("document_id") % 3 == 0, F.array(F.lit("ghost"))).otherwise(F.array().cast("array<string>"))
    body = F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"),
        F.struct(F.when(F.col("document_id") % 4 != 0, F.lit("2024-01-01T00:00:00Z")).alias("timestamp"), F.struct(F.array(F.struct(F.lit("maker").alias("name"))).alias("components")).alias("tools"), F.when(F.col("root").isNotNull(), F.col("rc").withField("components", F.col("inner.comp"))).alias("component")).alias("metadata"),
        F.col("outer.comp").alias("components"), F.when(F.col("root").isNotNull(), F.array(F.struct(F.col("root").alias("ref"), F.concat("rest", ghost).alias("dependsOn"), F.array(F.lit("api")).alias("provides")))).alias("dependencies"),
    )
    return by.select("document_id", F.to_json(body).alias("body"))


def _cdx_counts(x: Facts) -> DataFrame:
    parsed = written(cdx.parse(_cdx_bodies(x)))
    tidy(x.spark)
    comps, contains = cdx.components(parsed)
    rels = cdx.relationships(parsed, comps, contains)
    a = comps.groupBy("document_id").agg(F.count("*").alias("components"), F.count("purl").alias("purls"), F.count("license_raw").alias("licensed"), F.count("type").alias("typed"), F.count_if("is_root").alias("roots"))
    b = rels.groupBy("document_id").agg(*[F.count_if(F.col("relationship") == k).alias(k.lower()) for k in ("CONTAINS", "DEPENDS_ON", "PROVIDES")], F.count_if((F.col("relationship") == "DEPENDS_ON") & F.col("resolved")).alias("resolved"))
    return a.join(b, "document_id", "left").na.fill(0)


_INNER = "WITH " + _ROOTS + ", c AS (SELECT k.*, root_element, coalesce(element_id = root_element, false) AS top, root_element IS NOT NULL AND partkey % 5 = 0 AS nested, max(CASE WHEN element_id = root_element THEN partkey END) OVER (PARTITION BY k.snapshot_id) AS root_part FROM {components} k LEFT JOIN rt USING (snapshot_id))"
register("s8_cyclonedx", _cdx_counts, _INNER + """ SELECT snapshot_id AS document_id, count(*) AS components, count(purl) AS purls, count(*) FILTER (partkey % 4 <> 3) AS licensed, count(*) FILTER (partkey % 6 = 0) AS typed, count(*) FILTER (top) AS roots, count(*) FILTER (nested AND NOT top) AS contains,
CASE WHEN any_value(root_element) IS NULL THEN 0 ELSE count(*) - 1 + (snapshot_id % 3 = 0)::INT END AS depends_on, (any_value(root_element) IS NOT NULL)::BIGINT AS provides, coalesce(count(*) FILTER (root_part % 7 <> 0 AND partkey % 7 <> 0 AND NOT top), 0) AS resolved FROM c GROUP BY snapshot_id""")


def _cdx_warnings(x: Facts) -> DataFrame:
    parsed = written(cdx.parse(_cdx_bodies(x)))
    tidy(x.spark)
    comps, contains = cdx.components(parsed)
    return cdx.warnings(parsed, comps, cdx.relationships(parsed, comps, contains)).groupBy("code").agg(F.sum("n").alias("n"))


register("s8_warnings", _cdx_warnings, _INNER + """, w AS (SELECT 'package_id_missing' AS code FROM c WHERE partkey % 7 = 0 UNION ALL SELECT 'package_id_duplicate' FROM (SELECT row_number() OVER (PARTITION BY snapshot_id, element_id) AS rn FROM c WHERE partkey % 7 > 0) z WHERE rn > 1 UNION ALL SELECT 'package_version_missing' FROM c WHERE version IS NULL UNION ALL SELECT 'package_purl_missing' FROM c WHERE purl IS NULL UNION ALL SELECT 'license_list_ambiguous' FROM c WHERE partkey % 4 = 2
UNION ALL SELECT 'package_version_mismatch' FROM c WHERE purl IS NOT NULL AND version IS NOT NULL UNION ALL SELECT 'root_missing' FROM (SELECT DISTINCT snapshot_id FROM c WHERE root_element IS NULL) z UNION ALL SELECT 'created_missing' FROM (SELECT DISTINCT snapshot_id FROM c WHERE snapshot_id % 4 = 0) z
UNION ALL SELECT 'relationship_unresolved' FROM c WHERE root_part % 7 <> 0 AND partkey % 7 = 0 AND NOT top UNION ALL SELECT 'relationship_unresolved' FROM c WHERE top AND root_part % 7 <> 0 AND snapshot_id % 3 = 0 UNION ALL SELECT 'relationship_unresolved' FROM c WHERE top AND root_part % 7 = 0)
SELECT code, count(*) AS n FROM w GROUP BY code""")


_HEADER = {"name": "inventory", "created": "2024-01-01T00:00:00Z", "tool": "inventory"}


def _spdx_bodies(x: Facts) -> DataFrame:
    c = x.components.drop("license_raw").join(x.licences.select("partkey", F.col("expression").alias("license_raw")), "partkey")
    comps = c.select(F.col("snapshot_id").alias("document_id"), F.xxhash64("element_id").alias("ordinal"), "element_id", "name", "version", "purl", "license_raw", "is_root")
    # lines that repeat are components of their own; stored, because packages, edges and ids are all made of them
    again = F.row_number().over(Window.partitionBy("document_id", "element_id").orderBy("version", "purl"))
    comps = written(comps.withColumn("element_id", F.when(again > 1, F.concat_ws("#", "element_id", again)).otherwise(F.col("element_id"))))
    tidy(x.spark)
    first = comps.groupBy("document_id").agg(F.min_by("element_id", "ordinal").alias("from_element"))
    rels = comps.filter("NOT is_root").select("document_id", "ordinal", F.lit("DEPENDS_ON").alias("relationship"), F.col("element_id").alias("to_element"), F.lit(True).alias("resolved")).join(first, "document_id")
    return sbom.export(comps, rels, _HEADER)


#: Elements whose names clash once they are sanitised, and edges of several types, some of them unresolved or describing.
_LISTED = """SELECT snapshot_id AS document_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY element_id) AS ordinal,
  CASE WHEN partkey % 5 = 0 THEN concat('pkg', CASE partkey % 3 WHEN 0 THEN ':' WHEN 1 THEN '/' ELSE ' ' END, CAST(length(element_id) % 2 AS STRING), CASE WHEN partkey % 2 = 0 THEN '!' ELSE '?' END) ELSE element_id END AS element_id,
  name, version, purl, license_raw, is_root, partkey FROM {components}"""
_ELEMENTS = "SELECT document_id, min(ordinal) AS ordinal, element_id, min(name) AS name, min(version) AS version, min(purl) AS purl, min(license_raw) AS license_raw, bool_or(is_root) AS is_root FROM ({listed}) q GROUP BY document_id, element_id"
_EDGES = """SELECT document_id, ordinal, element_id AS from_element, lead(element_id) OVER (PARTITION BY document_id ORDER BY ordinal) AS to_element,
  CASE partkey % 4 WHEN 0 THEN 'DEPENDS_ON' WHEN 1 THEN 'CONTAINS' WHEN 2 THEN 'DESCRIBES' ELSE 'DEV_DEPENDENCY_OF' END AS relationship, partkey % 7 > 0 AS resolved FROM ({listed}) q"""


def _exported(x: Facts) -> DataFrame:
    listed = _LISTED.replace("{components}", "{c}")
    comps = written(x.spark.sql(_ELEMENTS.replace("{listed}", listed), c=x.components))
    rels = written(x.spark.sql(_EDGES.replace("{listed}", listed), c=x.components).filter("to_element IS NOT NULL"))
    tidy(x.spark)
    parsed = written(sbom.parse(sbom.export(comps, rels, _HEADER)))
    tidy(x.spark)
    edges = parsed.select("document_id", F.explode("d.relationships").alias("r")).select("document_id", F.col("r.spdxElementId").alias("a"), F.col("r.relationshipType").alias("kind"), F.col("r.relatedSpdxElement").alias("b"))
    named = parsed.select("document_id", F.explode("d.packages").alias("p")).select("document_id", F.col("p.SPDXID").alias("a"), F.col("p.licenseDeclared").alias("kind"), F.col("p.name").alias("b"))
    return edges.unionByName(named).groupBy("document_id", "a", "kind", "b").agg(F.count("*").alias("n"))


register(
    "s13_spdx_export",
    _exported,
    f"""WITH l AS ({_LISTED}), e AS ({_ELEMENTS.replace("{listed}", _LISTED)}), r AS ({_EDGES.replace("{listed}", _LISTED)}),
b AS (SELECT *, concat('SPDXRef-', regexp_replace(element_id, '[^A-Za-z0-9.-]', '-', 'g')) AS base FROM e), i AS (SELECT *, row_number() OVER (PARTITION BY document_id, base ORDER BY ordinal) AS k FROM b),
d AS (SELECT *, CASE WHEN k = 1 THEN base ELSE concat(base, '-', k) END AS spdx_id FROM i),
o AS (SELECT document_id, 'SPDXRef-DOCUMENT' AS a, 'DESCRIBES' AS kind, spdx_id AS b FROM d WHERE is_root
  UNION ALL SELECT r.document_id, f.spdx_id, r.relationship, t.spdx_id FROM r JOIN d f ON f.document_id = r.document_id AND f.element_id = r.from_element JOIN d t ON t.document_id = r.document_id AND t.element_id = r.to_element WHERE r.resolved AND r.relationship <> 'DESCRIBES'
  UNION ALL SELECT document_id, spdx_id, CASE WHEN license_raw IS NULL OR license_raw IN ('NOASSERTION', ' unlicensed ') THEN 'NOASSERTION' ELSE license_raw END, name FROM d)
SELECT document_id, a, kind, b, count(*) AS n FROM o GROUP BY ALL""",
)


def _spdx_counts(x: Facts) -> DataFrame:
    parsed = written(sbom.parse(_spdx_bodies(x)))
    tidy(x.spark)
    comps = sbom.components(parsed)
    rels = sbom.relationships(parsed, comps)
    a = comps.groupBy("document_id").agg(F.count("*").alias("components"), F.count("purl").alias("purls"), F.count_if(F.col("version").isNull()).alias("without_version"), F.count_if(F.col("license_declared") == "NOASSERTION").alias("unasserted"))
    b = rels.groupBy("document_id").agg(F.count_if("resolved").alias("resolved"))
    c = sbom.roots(parsed, comps, rels).groupBy("document_id").agg(F.count("*").alias("roots"))
    return a.join(b, "document_id", "left").join(c, "document_id", "left").na.fill(0)


register("s7_spdx_round_trip", _spdx_counts, "SELECT snapshot_id AS document_id, count(*) AS components, count(purl) AS purls, count(*) FILTER (version IS NULL) AS without_version, count(*) FILTER (form >= 7) AS unasserted, count(*) AS resolved, count(*) FILTER (is_root) AS roots FROM {components} JOIN {licences} USING (partkey) GROUP BY snapshot_id")


def _spdx_warnings(x: Facts) -> DataFrame:
    body, k = F.col("body"), F.col("document_id") % 5
    broken = F.when(k == 0, F.regexp_replace(body, '"SPDXID":"SPDXRef-DOCUMENT",', "")).when(k == 1, F.replace(body, F.lit("2024-01-01T00:00:00Z"), F.lit("then"))).when(k == 2, F.replace(body, F.lit('"Tool: '), F.lit('"Person: '))).when(k == 3, F.replace(body, F.lit('"relationshipType":"DESCRIBES"'), F.lit('"relationshipType":""'))).otherwise(F.replace(body, F.lit('"spdxElementId":"SPDXRef-DOCUMENT","relationshipType":"DESCRIBES"'), F.lit('"spdxElementId":"SPDXRef-ghost","relationshipType":"DESCRIBES"')))
    parsed = sbom.parse(_spdx_bodies(x).select("document_id", broken.alias("body")))
    comps = sbom.components(parsed)
    return sbom.warnings(parsed, comps, sbom.relationships(parsed, comps)).groupBy("code").agg(F.sum("n").alias("n"))


register("s7_warnings", _spdx_warnings, """WITH d AS (SELECT snapshot_id, snapshot_id % 5 AS k, count(*) FILTER (is_root) AS roots FROM {components} GROUP BY snapshot_id), w AS (SELECT 'document_id_missing' AS code, 1 AS n FROM d WHERE k = 0 UNION ALL SELECT 'created_invalid', 1 FROM d WHERE k = 1 UNION ALL SELECT 'creator_tool_missing', 1 FROM d WHERE k = 2
UNION ALL SELECT 'relationship_incomplete', roots FROM d WHERE k = 3 UNION ALL SELECT 'relationship_unresolved', roots FROM d WHERE k = 4 UNION ALL SELECT 'root_missing', 1 FROM d WHERE k IN (3, 4) OR roots = 0 UNION ALL SELECT 'package_version_missing', 1 FROM {components} WHERE version IS NULL UNION ALL SELECT 'package_purl_missing', 1 FROM {components} WHERE purl IS NULL
UNION ALL SELECT 'package_version_mismatch', 1 FROM {components} WHERE purl IS NOT NULL AND version IS NOT NULL) SELECT code, sum(n)::BIGINT AS n FROM w GROUP BY code HAVING sum(n) > 0""")
register("s9_detect", lambda x: x.components.select("snapshot_id").distinct().join(_spdx_bodies(x).withColumnRenamed("body", "a"), F.col("snapshot_id") == F.col("document_id")).drop("document_id").join(_cdx_bodies(x).withColumnRenamed("body", "b"), F.col("snapshot_id") == F.col("document_id")).select("snapshot_id", sbom.detect(F.when(F.col("snapshot_id") % 3 == 0, F.col("a")).when(F.col("snapshot_id") % 3 == 1, F.concat(F.lit("  "), "b")).otherwise(F.substring("a", 2, 1 << 30))).alias("format")), "SELECT DISTINCT snapshot_id, CASE snapshot_id % 3 WHEN 0 THEN 'spdx' WHEN 1 THEN 'cyclonedx' ELSE 'unknown' END AS format FROM {components}")
register("s10_purl", lambda x: x.components.select("snapshot_id", "element_id", pu.parse_purl(F.col("purl")).alias("u")).select("snapshot_id", "element_id", F.col("u.type").alias("type"), F.col("u.name").alias("name"), F.col("u.version").alias("version"), F.col("u.qualifiers")["arch"].alias("arch")), """SELECT snapshot_id, element_id, CASE WHEN purl IS NOT NULL THEN lower(namespace) END AS type, CASE WHEN purl IS NOT NULL THEN name END AS name, CASE WHEN purl IS NOT NULL THEN split_part(split_part(purl, '@', 2), '?', 1) END AS version, CASE WHEN purl IS NOT NULL THEN split_part(purl, 'arch=', 2) END AS arch FROM {components}""")
_STRICT = "SELECT occurrence, concat('pkg:', CASE ordinal % 5 WHEN 0 THEN 'NPM' WHEN 1 THEN 'golang' WHEN 2 THEN 'deb' WHEN 3 THEN 'pypi' ELSE 'maven' END, '/', replace(name, ' ', '%20'), CASE WHEN line % 4 = 0 THEN '' ELSE concat('@', CAST(line AS STRING)) END, CASE WHEN line % 9 = 1 THEN '?a=b' ELSE '' END) AS purl FROM {entities}"
register("s10_strict", lambda x: x.spark.sql(_STRICT, entities=x.entities).select("occurrence", pu.strict_purl(F.col("purl")).alias("u")).filter("u IS NOT NULL").select("occurrence", "u.manager", "u.name", "u.version"), "SELECT occurrence, CASE ordinal % 5 WHEN 0 THEN 'npm' WHEN 1 THEN 'gomod' WHEN 3 THEN 'pip' ELSE 'maven' END AS manager, name, CAST(line AS VARCHAR) AS version FROM {entities} WHERE ordinal % 5 <> 2 AND line % 4 <> 0 AND line % 9 <> 1")
register("s11_document_store", lambda x: sbom.store(x.documents, "text").select("sha256", "n", F.char_length("body").alias("size")), "SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS n, any_value(length(coalesce(text, '')))::INT AS size FROM {documents} GROUP BY 1")
register("s12_export_rows", lambda x: p.export_rows(x.components, x.snapshots.withColumn("collected_at", F.col("collected_at").cast("timestamp")), x.repositories.withColumn("name", F.concat(F.lit("=cmd "), "name"))).select("repository", "snapshot_id", "element_id", "collected_at", "version", "license_declared_raw", "is_root", "producer"), """SELECT concat(chr(39), '=cmd ', r.name) AS repository, CAST(c.snapshot_id AS VARCHAR) AS snapshot_id, element_id, strftime(collected_at, '%Y-%m-%dT%H:%M:%SZ') AS collected_at, coalesce(version, '') AS version, coalesce(license_raw, '') AS license_declared_raw, CAST(is_root AS VARCHAR) AS is_root, '' AS producer
FROM {components} c JOIN {snapshots} s ON s.id = c.snapshot_id JOIN {repositories} r ON r.id = s.repository_id""")
register("s14_text_corpus", lambda x: fx.text_corpus(x.corpus.withColumn("commit", F.lit("c")), 4000).select("path"), "SELECT path FROM {corpus} WHERE strlen(text) <= 4000")

_GEN = "CAST(length(%s) %% 3 AS BIGINT) AS repository_id, CAST(1 AS BIGINT) AS upload_id"
_V_NODES = "SELECT " + _GEN % "occurrence" + ", occurrence, CASE WHEN ordinal % 41 = 1 THEN concat(path, '.gone') ELSE path END AS path, line, CASE WHEN ordinal % 37 = 1 THEN line - 1 ELSE line END AS end_line FROM {nodes} UNION ALL SELECT " + _GEN % "occurrence" + ", occurrence, NULL, 1, 1 FROM {nodes} WHERE ordinal % 50 = 1"
_V_EDGES = "SELECT " + _GEN % "source" + ", occurrence, source, target, CASE WHEN occurrence LIKE '%99' THEN 'sees' ELSE kind END AS kind, CASE WHEN occurrence LIKE '%98' THEN 1.5 ELSE confidence END AS confidence FROM {edges}"
_V_FILES = "SELECT k.repository_id, CAST(1 AS BIGINT) AS upload_id, path, CASE WHEN size % 7 = 0 THEN 'zz' ELSE sha2(path, 256) END AS content_hash FROM {files} CROSS JOIN (SELECT CAST(0 AS BIGINT) AS repository_id UNION ALL SELECT 1 UNION ALL SELECT 2) k"
_V_REFS = "SELECT " + _GEN % "source" + ", occurrence, source FROM {unresolved}"


def _bad(x: Facts) -> DataFrame:
    sql = lambda q, *t: x.spark.sql(q, **{k: getattr(x, k) for k in t})
    return fx.violations(sql(_V_NODES, "nodes"), sql(_V_EDGES, "edges"), sql(_V_FILES, "files"), sql(_V_REFS, "unresolved"))


_K = "repository_id, upload_id"
register("s2_violations", _bad, f"""WITH n AS ({_V_NODES}), e AS ({_V_EDGES}), f AS ({_V_FILES.replace("sha2(path, 256)", "sha256(path)")}), u AS ({_V_REFS})
SELECT {_K}, 'duplicate node' AS rule, occurrence AS subject FROM n GROUP BY {_K}, occurrence HAVING count(*) > 1 UNION ALL SELECT {_K}, 'duplicate edge', occurrence FROM e GROUP BY {_K}, occurrence HAVING count(*) > 1
UNION ALL SELECT {_K}, 'dangling source', occurrence FROM e WHERE (repository_id, source) NOT IN (SELECT repository_id, occurrence FROM n) UNION ALL SELECT {_K}, 'dangling target', occurrence FROM e WHERE (repository_id, target) NOT IN (SELECT repository_id, occurrence FROM n)
UNION ALL SELECT {_K}, 'dangling reference', occurrence FROM u WHERE (repository_id, source) NOT IN (SELECT repository_id, occurrence FROM n) UNION ALL SELECT {_K}, 'unknown kind', occurrence FROM e WHERE kind = 'sees' UNION ALL SELECT {_K}, 'bad confidence', occurrence FROM e WHERE confidence > 1
UNION ALL SELECT {_K}, 'bad location', occurrence FROM n WHERE end_line < line UNION ALL SELECT {_K}, 'bad file hash', path FROM f WHERE content_hash = 'zz' UNION ALL SELECT {_K}, 'unknown path', occurrence FROM n WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM f)""")


def _published(x: Facts) -> DataFrame:
    """Facts of three repositories written to the shared folder but for the one with violations, and read again by generation."""
    folder = f"{shared_dir(x.spark)}/facts-{abs(hash(x.sf_dir)) % 1_000_000}-{id(x)}"
    rows = x.spark.sql("SELECT " + _GEN % "path" + ", * FROM {nodes}", nodes=x.nodes)
    fx.publish(folder, {"nodes": rows}, x.spark.createDataFrame([(1, 1)], "repository_id long, upload_id long"))
    wanted = x.spark.createDataFrame([(0, 1), (1, 1)], "repository_id long, upload_id long")
    return fx.load(x.spark, folder, "nodes", wanted).select("occurrence", "path", "kind")


register("s1_load_published", _published, "SELECT occurrence, path, kind FROM {nodes} WHERE length(path) % 3 = 0")
_DB = """SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, concat('n', CAST(l_partkey AS STRING)) AS source, concat('n', CAST(l_suppkey AS STRING)) AS target, CASE l_linenumber WHEN 1 THEN 'calls' WHEN 2 THEN 'weird' ELSE 'imports' END AS kind,
CASE WHEN l_quantity < 10 THEN concat('{{"confidence":', CAST(l_linenumber AS STRING), '.5,"resolvedBy":"import"}}') WHEN l_quantity < 20 THEN '{{"other":1}}' END AS metadata, CAST(l_linenumber AS INT) AS line, CAST(2 AS INT) AS col, CAST(NULL AS STRING) AS provenance FROM {lineitem}"""
register("s5_import_edges", lambda x: fx.import_edges(x.spark.sql(_DB, lineitem=x.lineitem), "demo")[0].groupBy("source", "target", "kind", "confidence", "reason", F.col("start.line").alias("line")).agg(F.count("*").alias("n"), F.countDistinct("occurrence").alias("distinct")), f"""WITH d AS ({_DB})
SELECT source, target, kind, CASE WHEN metadata LIKE '%confidence%' THEN line + 0.5 END::DOUBLE AS confidence, CASE WHEN metadata LIKE '%confidence%' THEN 'import' END AS reason, line - 1 AS line, count(*) AS n, count(*) AS "distinct" FROM d WHERE kind <> 'weird' GROUP BY ALL""")
register("s5_rejected", lambda x: fx.import_edges(x.spark.sql(_DB, lineitem=x.lineitem), "demo")[1], f"WITH d AS ({_DB}) SELECT kind, count(*) AS n FROM d WHERE kind = 'weird' GROUP BY kind")
_DBN = """SELECT concat('n', CAST(p_partkey AS STRING)) AS id, 'class' AS kind, p_name AS name, p_name AS qualified_name, p_type AS file_path, 'go' AS language, CAST(NULL AS STRING) AS signature, CAST(NULL AS STRING) AS visibility, CASE WHEN p_size % 3 < 2 THEN p_size % 3 END AS is_exported, 0 AS is_async, 1 AS is_static, CAST(NULL AS INT) AS is_abstract,
concat('["', p_brand, '","x"]') AS decorators, CAST(NULL AS STRING) AS type_parameters, CAST(NULL AS STRING) AS return_type, CAST(p_size AS INT) AS start_line, 0 AS start_column, CAST(p_size + 2 AS INT) AS end_line, 4 AS end_column FROM {part}"""
register("s5_import_nodes", lambda x: fx.import_nodes(x.spark.sql(_DBN, part=x.part)).select("occurrence", "is_exported", F.array_join("decorators", "|").alias("decorators"), F.col("location.start.line").alias("line"), F.col("location.end.line").alias("end_line")), f"WITH d AS ({_DBN}) SELECT id AS occurrence, CASE WHEN is_exported IS NOT NULL THEN is_exported <> 0 END AS is_exported, concat(substr(decorators, 3, length(decorators) - 8), '|x') AS decorators, CASE WHEN start_line > 0 THEN start_line - 1 END AS line, end_line - 1 AS end_line FROM d")
register("s5_report", lambda x: fx.import_report(x.nodes, x.edges), "SELECT 'node' AS category, kind, count(*) AS n FROM {nodes} GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM {edges} GROUP BY kind")

_STATES = _LATEST + ", st AS (SELECT repository_id, max(collected_at) AS seen_at, arg_max(outcome, (collected_at, snapshot_id)) AS outcome, sum(n) AS components FROM latest LEFT JOIN (SELECT snapshot_id, count(*) AS n FROM {components} GROUP BY 1) c USING (snapshot_id) GROUP BY repository_id)"
register("p2_overview", lambda x: p.overview(p.authorised(x.repositories), _latest(x).join(x.components.groupBy("snapshot_id").agg(F.count("*").alias("components")), "snapshot_id", "left"), NOW, 200, x.repositories.filter("id % 9 = 0").select(F.col("id").alias("repository_id"))), f"""WITH {_STATES}
SELECT count(*) AS repositories, count(seen_at) AS with_inventory, count(*) FILTER (seen_at < TIMESTAMP '{NOW}' - INTERVAL 400 DAY) AS stale, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (seen_at IS NULL) AS never, min(seen_at) AS oldest, max(seen_at) AS newest, count(*) FILTER (id % 9 = 0) AS opted_out, coalesce(sum(components), 0)::BIGINT AS components FROM repos LEFT JOIN st ON repository_id = id""")
_PAGE = """SELECT ecosystem, namespace, name, version, count(*) AS occurrences, count(DISTINCT snapshot_id) AS snapshots, coalesce(string_agg(DISTINCT status, ',' ORDER BY status), '') AS statuses, coalesce(string_agg(DISTINCT license_raw, ',' ORDER BY license_raw), '') AS licenses,
CASE WHEN count(DISTINCT status) = 0 THEN 'unassessed' WHEN count(DISTINCT status) = 1 AND count(status) = count(*) THEN max(status) ELSE 'mixed' END AS label FROM {components}"""
_flat = lambda df: df.withColumn("statuses", F.array_join("statuses", ",")).withColumn("licenses", F.array_join("licenses", ",")).drop("expression")
register("p4_component_page", lambda x: _flat(p.component_page(x.components, search="bolt")), _PAGE + " WHERE contains(lower(name), 'bolt') OR contains(lower(coalesce(purl, '')), 'bolt') GROUP BY ecosystem, namespace, name, version")
register("p4_next_page", lambda x: _flat(p.component_page(x.components, ecosystem="Brand#21", licence="LGPL-2.1-only AND MIT", status="unlicensed", after=("Brand#21", "MEDIUM", "g", ""), limit=25)), _PAGE + " WHERE ecosystem = 'Brand#21' AND license_raw = 'LGPL-2.1-only AND MIT' AND status = 'unlicensed' AND (namespace > 'MEDIUM' OR namespace = 'MEDIUM' AND name > 'g') GROUP BY ecosystem, namespace, name, version ORDER BY ecosystem, namespace, name, coalesce(version, '') LIMIT 25")
_SHARED = _LATEST + """, us AS (SELECT * FROM {components} JOIN latest USING (snapshot_id)), sh AS (SELECT ecosystem, namespace, name, count(DISTINCT repository_id) AS repositories FROM us GROUP BY ALL HAVING count(DISTINCT repository_id) >= 3),
top AS (SELECT *, (SELECT count(*) FROM sh) AS matching FROM sh ORDER BY repositories DESC, ecosystem, namespace, name LIMIT 150)"""
register("p5_shared", lambda x: p.shared_packages(x.components, _latest(x), 3, 150).select("ecosystem", "namespace", "name", "repositories", "matching", "occurrences", "risky", F.array_join("versions", ",").alias("versions"), F.array_join("statuses", ",").alias("statuses"), "snapshots"), f"""WITH {_SHARED} SELECT ecosystem, namespace, name, repositories, matching, count(*) AS occurrences, coalesce(bool_or(status IN ('conflict', 'unlicensed')), false) AS risky, coalesce(string_agg(DISTINCT version, ',' ORDER BY version), '') AS versions, coalesce(string_agg(DISTINCT status, ',' ORDER BY status), '') AS statuses, count(DISTINCT snapshot_id) AS snapshots FROM top JOIN us USING (ecosystem, namespace, name) GROUP BY ALL""")
register("p21_bipartite_edges", lambda x: p.bipartite(x.components, _latest(x), p.shared_packages(x.components, _latest(x), 3, 150))[1], f"WITH {_SHARED} SELECT DISTINCT concat_ws(chr(1), ecosystem, namespace, name) AS package, repository_id FROM us JOIN top USING (ecosystem, namespace, name)")
register("p21_bipartite_nodes", lambda x: p.bipartite(x.components, _latest(x), p.shared_packages(x.components, _latest(x), 3, 150))[0], f"""WITH {_SHARED} SELECT concat_ws(chr(1), ecosystem, namespace, name) AS node, 'package' AS kind, coalesce(bool_or(status IN ('conflict', 'unlicensed')), false) AS risky, matching > (SELECT count(*) FROM top) AS partial FROM us JOIN top USING (ecosystem, namespace, name) GROUP BY ecosystem, namespace, name, matching
UNION ALL SELECT DISTINCT CAST(repository_id AS VARCHAR), 'repository', false, false FROM us JOIN top USING (ecosystem, namespace, name)""")


def _scopes(x: Facts) -> DataFrame:
    """Dependency scope of the components of the latest snapshots: each line depends on the next one of its snapshot."""
    of = Window.partitionBy("snapshot_id").orderBy("element_id")
    node = lambda c: F.concat_ws("/", "snapshot_id", c)
    c = x.components.select("snapshot_id", "element_id", "is_root").withColumn("next", F.lead("element_id").over(of))
    step = c.filter("next IS NOT NULL").select(node("element_id").alias("here"), node("next").alias("there"))
    reached = t.levels(step, c.filter("is_root").select(F.col("snapshot_id").alias("query_id"), node("element_id").alias("node")), 64)
    return reached.select(F.col("query_id").alias("snapshot_id"), F.substring_index("node", "/", -1).alias("element_id"), F.when(F.col("depth") == 0, "root").when(F.col("depth") == 1, "direct").otherwise("transitive").alias("scope"))


_SCOPED = """WITH k AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY element_id) AS ord FROM {components}), r AS (SELECT *, max(CASE WHEN is_root THEN ord END) OVER (PARTITION BY snapshot_id ORDER BY ord) AS last FROM k),
sc AS (SELECT *, CASE WHEN last IS NULL THEN 'unknown' WHEN ord = last THEN 'root' WHEN ord = last + 1 THEN 'direct' ELSE 'transitive' END AS scope FROM r)"""
register("g22_dependency_scope", lambda x: p.component_list(x.components.withColumn("ordinal", F.col("element_id")), _scopes(x), size=1 << 30).select("snapshot_id", "element_id", "scope"), _SCOPED + " SELECT snapshot_id, element_id, scope FROM sc")
register("p8_component_list", lambda x: p.component_list(x.components.withColumn("ordinal", F.col("partkey")), _scopes(x), "bolt", 1, 2), _SCOPED + """ SELECT * FROM (SELECT snapshot_id, element_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY partkey, element_id) AS no, name, version, is_root, scope, coalesce(status, 'unassessed') AS status FROM sc WHERE contains(lower(name), 'bolt') OR contains(lower(coalesce(purl, '')), 'bolt')) q WHERE no > 1 AND no <= 3""")
_DEPENDS = "SELECT snapshot_id, 'top' AS from_element, 'DEPENDS_ON' AS relationship, element_id AS to_element FROM {components} WHERE partkey % 2 = 0"
_EVID = "SELECT ecosystem, namespace, name, concat('s', CAST(snapshot_id % 3 AS STRING)) AS source, license_raw, snapshot_id AS id FROM {components} WHERE snapshot_id % 10 = 0"


def _detail(x: Facts) -> DataFrame:
    sql = lambda q: x.spark.sql(q, components=x.components)
    d = p.component_detail(x.components, _scopes(x), sql(_DEPENDS), sql(_EVID), x.components.filter("partkey % 6 = 0").select("snapshot_id", "element_id"))
    return d.select("snapshot_id", "element_id", "scope", "status", F.coalesce(F.size("relationships"), F.lit(0)).alias("relationships"), F.coalesce(F.size("evidence"), F.lit(0)).alias("evidence"), F.try_element_at("evidence", F.lit(1))["id"].alias("newest"))


register("p10_component_detail", _detail, _SCOPED + f""", ev AS (SELECT DISTINCT * FROM ({_EVID}) z), en AS (SELECT ecosystem, namespace, name, count(*) AS evidence, max(id) AS newest FROM ev GROUP BY ALL)
SELECT snapshot_id, element_id, scope, coalesce(status, 'unassessed') AS status, 1 AS relationships, coalesce(evidence, 0)::INT AS evidence, newest FROM sc LEFT JOIN en USING (ecosystem, namespace, name) WHERE partkey % 6 = 0""")
_PAIRED = "SELECT id AS pair_id, prior AS before, id AS after FROM (SELECT id, lag(id) OVER (PARTITION BY repository_id ORDER BY id) AS prior FROM {snapshots}) q WHERE prior IS NOT NULL"
_LINKS = "SELECT snapshot_id, ecosystem AS from_element, 'DEPENDS_ON' AS relationship, name AS to_element FROM {components}"
register("p11_compare_snapshots", lambda x: p.compare_snapshots(x.components.withColumn("element_id", F.col("name")), x.spark.sql(_LINKS, components=x.components), x.snapshots, x.spark.sql(_PAIRED, snapshots=x.snapshots)), f"""WITH pr AS ({_PAIRED}), li AS ({_LINKS}),
ck AS (SELECT DISTINCT snapshot_id, ecosystem, namespace, name, coalesce(version, '') AS v FROM {{components}}), a AS (SELECT pair_id, ecosystem, namespace, name, v FROM pr JOIN ck ON snapshot_id = before), b AS (SELECT pair_id, ecosystem, namespace, name, v FROM pr JOIN ck ON snapshot_id = after),
ea AS (SELECT DISTINCT pair_id, from_element, to_element FROM pr JOIN li ON snapshot_id = before), eb AS (SELECT DISTINCT pair_id, from_element, to_element FROM pr JOIN li ON snapshot_id = after),
ch AS (SELECT pair_id, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) z UNION ALL SELECT pair_id, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) z UNION ALL SELECT pair_id, 'edge_removed' FROM (SELECT * FROM ea EXCEPT SELECT * FROM eb) z UNION ALL SELECT pair_id, 'edge_added' FROM (SELECT * FROM eb EXCEPT SELECT * FROM ea) z
UNION ALL SELECT pair_id, 'license_changed' FROM pr JOIN {{components}} o ON o.snapshot_id = before JOIN {{components}} n ON n.snapshot_id = after AND n.ecosystem = o.ecosystem AND n.namespace = o.namespace AND n.name = o.name AND coalesce(n.version, '') = coalesce(o.version, '') WHERE n.license_raw IS DISTINCT FROM o.license_raw
UNION ALL SELECT pair_id, unnest(list_filter([CASE WHEN o.stream_key <> n.stream_key THEN 'changed_stream_key' END, CASE WHEN o.outcome <> n.outcome THEN 'changed_outcome' END, CASE WHEN o.digest <> n.digest THEN 'changed_digest' END], lambda c: c IS NOT NULL)) FROM pr JOIN {{snapshots}} o ON o.id = before JOIN {{snapshots}} n ON n.id = after)
SELECT pair_id, change, count(*) AS n FROM ch GROUP BY 1, 2""")
register("p15_history_rules", lambda x: p.history_rules(x.snapshots, x.decisions.select("id", "repository_id", F.when(F.col("id") % 4 > 0, F.col("created_at")).alias("finished_at")), x.events.select(F.col("event_id").alias("id"), F.col("ts").alias("received_at")), "2024-01-25 00:00:00", 1, 5, 10, 12), """SELECT 'collection' AS what, id FROM (SELECT id, row_number() OVER (PARTITION BY repository_id, stream_key ORDER BY id DESC) AS no FROM {snapshots}) q WHERE no > 1
UNION ALL SELECT 'job', id FROM (SELECT id, created_at, row_number() OVER (PARTITION BY repository_id ORDER BY id DESC) AS no FROM {decisions} WHERE id % 4 > 0) q WHERE no > 5 OR created_at < TIMESTAMP '2024-01-25' - INTERVAL 10 DAY UNION ALL SELECT 'delivery', event_id FROM {events} WHERE ts < TIMESTAMP '2024-01-25' - INTERVAL 12 DAY""")
_STREAMS = "SELECT repository_id, stream_key, max(CASE WHEN id % 10 > 0 THEN collected_at END) AS last_attempt, min(id) % 11 = 0 AS opt_out FROM {snapshots} GROUP BY repository_id, stream_key"
register("p16_due", lambda x: p.due_streams(x.spark.sql(_STREAMS, snapshots=x.snapshots), x.repositories, "2000-01-01 00:00:00", x.snapshots.filter("digest % 7 = 0")).select("repository_id", "stream_key", "last_attempt"), f"WITH {_REPOS}, s AS ({_STREAMS}) SELECT repository_id, stream_key, last_attempt FROM s WHERE NOT opt_out AND repository_id IN (SELECT id FROM repos) AND (last_attempt IS NULL OR last_attempt < TIMESTAMP '2000-01-01') AND (repository_id, stream_key) NOT IN (SELECT repository_id, stream_key FROM {{snapshots}} WHERE digest % 7 = 0)")
register("p20_facet_sums", lambda x: p.facet_sums(p.facets_by_repository(x.components, _latest(x), ["status", "license_raw"])), f"""WITH {_LATEST}, v AS (SELECT 'status' AS facet, coalesce(status, 'unassessed') AS value FROM {{components}} JOIN latest USING (snapshot_id) UNION ALL SELECT 'license_raw', coalesce(license_raw, 'none') FROM {{components}} JOIN latest USING (snapshot_id)), c AS (SELECT facet, value, count(*) AS n FROM v GROUP BY 1, 2)
SELECT facet, value, n, CASE facet WHEN 'status' THEN sum(CASE WHEN value <> 'unassessed' THEN n ELSE 0 END) OVER (PARTITION BY facet) / sum(n) OVER (PARTITION BY facet) END AS share FROM c""")

register("a12_unresolved_of", lambda x: g.unresolved_of(x.unresolved, x.nodes.filter("ordinal % 3 = 0").select(F.col("ordinal").alias("query_id"), F.col("occurrence").alias("source"))), "SELECT n.ordinal AS query_id, u.occurrence, u.name, row_number() OVER (PARTITION BY n.ordinal ORDER BY u.ordinal) AS no FROM {unresolved} u JOIN {nodes} n ON n.occurrence = u.source WHERE n.ordinal % 3 = 0")
register("a15_generated_files", lambda x: g.generated_files(x.files), "SELECT count(*) FILTER (generated) AS generated, count(*) AS total FROM {files}")
register("a16_overview", lambda x: g.overview_counts({"repository": x.repositories.select("status"), "snapshot": x.snapshots.select(F.col("outcome").alias("status")), "delivery": x.events.select(F.col("event_type").alias("status")), "job": x.decisions.select(F.col("kind").alias("status")), "package": x.components.select(F.coalesce("ecosystem", F.lit("none")).alias("status")), "installation": x.repositories.select("installation_id").distinct().select(F.lit("active").alias("status"))}), """SELECT 'repository' AS category, status, count(*) AS n FROM {repositories} GROUP BY status UNION ALL SELECT 'snapshot', outcome, count(*) FROM {snapshots} GROUP BY outcome UNION ALL SELECT 'delivery', event_type, count(*) FROM {events} GROUP BY event_type UNION ALL SELECT 'job', kind, count(*) FROM {decisions} GROUP BY kind
UNION ALL SELECT 'package', ecosystem, count(*) FROM {components} GROUP BY ecosystem UNION ALL SELECT 'installation', 'active', count(DISTINCT installation_id) FROM {repositories}""")
