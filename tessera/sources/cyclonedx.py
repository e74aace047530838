"""CycloneDX 1.6 JSON to components, relationships and warnings. Nesting is opened level by level, all documents at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import written
from .purl import parse_purl

#: Nested components beyond this depth are reported, not opened.
DEPTH = 32
_DOCUMENT = """bomFormat string, specVersion string, serialNumber string, version int, metadata struct<timestamp: string, tools: string, component: string>, components array<string>,
dependencies array<struct<ref: string, dependsOn: array<string>, provides: array<string>>>"""
_COMPONENT = """`bom-ref` string, type string, `group` string, name string, version string, purl string, supplier struct<name: string>, hashes array<struct<alg: string, content: string>>,
licenses array<struct<expression: string, acknowledgement: string, license: struct<id: string, name: string, url: string, text: string, acknowledgement: string>>>, evidence string, components array<string>"""
PLAIN_TYPES = ("", "library", "application", "framework")


def parse(documents: DataFrame) -> DataFrame:
    """documents (document_id, body) with the parsed struct d; bodies that aren't CycloneDX 1.6 are left out."""
    return documents.select("document_id", F.from_json("body", _DOCUMENT).alias("d")).filter("d.bomFormat = 'CycloneDX' AND d.specVersion = '1.6'")


def components(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, contains): every component of every level in document order, and an edge from each to those inside it.

    The component of the metadata comes first and is the root. Ids missing or taken get one of their own from the ordinal.
    """
    one = parsed.filter("d.metadata.component IS NOT NULL").select("document_id", F.array(F.lit(0)).alias("at"), F.col("d.metadata.component").alias("j"))
    top = parsed.select("document_id", F.posexplode("d.components").alias("i", "j")).select("document_id", F.array(F.lit(1), F.col("i")).alias("at"), "j")
    level, all_ = one.unionByName(top), None
    for depth in range(DEPTH + 1):
        read = written(level.select("document_id", "at", F.lit(depth).alias("depth"), F.from_json("j", _COMPONENT).alias("c")))
        all_ = read if all_ is None else all_.unionByName(read)
        level = read.select("document_id", "at", F.posexplode("c.components").alias("i", "j")).select("document_id", F.concat("at", F.array("i")).alias("at"), "j")
        if level.isEmpty():
            break
    w = Window.partitionBy("document_id").orderBy("at")
    c = all_.withColumn("ordinal", F.row_number().over(w) - 1)
    text = lambda s: F.nullif(F.trim(f"c.{s}"), F.lit(""))
    own = F.coalesce(F.nullif(F.col("c.bom-ref"), F.lit("")), F.concat(F.lit("bomref-missing-"), F.col("ordinal").cast("string")))
    c = c.withColumn("own", own).withColumn("no", F.row_number().over(Window.partitionBy("document_id", "own").orderBy("ordinal")))
    element = F.when(F.col("no") > 1, F.concat("own", F.lit("#duplicate-"), F.col("ordinal").cast("string"))).otherwise(F.col("own"))
    name = F.concat_ws("/", F.nullif(F.col("c.group"), F.lit("")), text("name"))
    choice = lambda x: F.coalesce(F.nullif(x["expression"], F.lit("")), F.nullif(x["license"]["id"], F.lit("")), F.when(F.nullif(x["license"]["name"], F.lit("")).isNotNull(), F.concat(x["license"]["name"], F.coalesce(F.concat(F.lit(" ("), F.nullif(x["license"]["url"], F.lit("")), F.lit(")")), F.lit("")))), F.nullif(x["license"]["url"], F.lit("")), F.when(x["license"]["text"].isNotNull(), F.lit("LicenseRef-inline-text")))
    licences = F.filter(F.transform("c.licenses", choice), lambda x: x.isNotNull())
    c = c.select(
        "document_id", "ordinal", "at", "depth", element.alias("element_id"), F.coalesce(F.when(text("name").isNotNull(), name), element).alias("name"), F.col("c.version").alias("version"), F.nullif(F.col("c.purl"), F.lit("")).alias("purl"),
        F.when(~F.coalesce("c.type", F.lit("")).isin(*PLAIN_TYPES), F.col("c.type")).alias("type"), F.col("c.supplier.name").alias("supplier"), F.filter("c.hashes", lambda h: (h["alg"] != "") & (h["content"] != "")).alias("checksums"),
        F.when(F.size(licences) > 0, F.array_join(licences, "; ")).alias("license_raw"), (F.coalesce(F.size(licences), F.lit(0))).alias("licences"), (F.element_at("at", 1) == 0).alias("in_root"), ((F.element_at("at", 1) == 0) & (F.size("at") == 1)).alias("is_root"),
        F.coalesce("c.bom-ref", F.lit("")).alias("given_id"), (F.col("no") > 1).alias("duplicate"), text("name").isNull().alias("nameless"), F.col("c.evidence").isNotNull().alias("evidence"), F.coalesce(F.size("c.components"), F.lit(0)).alias("inner"),
        F.coalesce(F.exists("c.licenses", lambda x: x["license"]["name"].isNotNull() & x["license"]["id"].isNull() & x["expression"].isNull()), F.lit(False)).alias("named_licence"),
    )
    c = written(c)
    above = F.slice("at", F.lit(1), F.size("at") - 1)
    holds = c.filter(F.size("at") > F.when(F.col("in_root"), 1).otherwise(2)).select("document_id", above.alias("at"), F.col("element_id").alias("to_element"))
    contains = holds.join(c.select("document_id", "at", F.col("element_id").alias("from_element")), ["document_id", "at"])
    return c, contains.select("document_id", "from_element", F.lit("CONTAINS").alias("relationship"), "to_element", F.lit(True).alias("resolved"))


def relationships(parsed: DataFrame, comps: DataFrame, contains: DataFrame) -> DataFrame:
    """CONTAINS, DEPENDS_ON and PROVIDES edges; resolved when both ends are components of the document."""
    d = parsed.select("document_id", F.explode("d.dependencies").alias("x"))
    each = [d.select("document_id", F.col("x.ref").alias("from_element"), F.lit(kind).alias("relationship"), F.explode(f"x.{field}").alias("to_element")) for field, kind in (("dependsOn", "DEPENDS_ON"), ("provides", "PROVIDES"))]
    r = each[0].unionByName(each[1])
    for end in ("from", "to"):
        known = comps.select("document_id", F.col("element_id").alias(f"{end}_element"), F.lit(True).alias(f"_{end}")).distinct()
        r = r.join(known, ["document_id", f"{end}_element"], "left")
    return r.select("document_id", "from_element", "relationship", "to_element", (F.col("_from").isNotNull() & F.col("_to").isNotNull()).alias("resolved")).unionByName(contains)


def warnings(parsed: DataFrame, comps: DataFrame, rels: DataFrame) -> DataFrame:
    """(document_id, code, n): what a document lacks or says in a way that can't be carried."""
    p = comps.withColumn("u", parse_purl(F.col("purl")))
    stamp = F.nullif(F.col("d.metadata.timestamp"), F.lit(""))
    tool = F.coalesce(F.get_json_object("d.metadata.tools", "$.components[0].name"), F.get_json_object("d.metadata.tools", "$[0].name"), F.lit(""))
    refs = parsed.select("document_id", F.explode("d.dependencies.ref").alias("element_id")).join(comps.select("document_id", "element_id").distinct(), ["document_id", "element_id"], "left_anti")
    each = {
        "created_missing": parsed.filter(stamp.isNull()),
        "created_invalid": parsed.filter(stamp.isNotNull() & F.try_to_timestamp(stamp).isNull()),
        "creator_tool_missing": parsed.filter(tool == ""),
        "package_id_missing": comps.filter("given_id = ''"),
        "package_id_duplicate": comps.filter("duplicate"),
        "package_name_missing": comps.filter("nameless"),
        "package_version_missing": comps.filter(F.coalesce("version", F.lit("")) == ""),
        "package_purl_missing": comps.filter("purl IS NULL"),
        "package_purl_invalid": p.filter("purl IS NOT NULL AND u IS NULL"),
        "package_version_mismatch": p.filter("version <> u.version"),
        "evidence_not_carried": comps.filter("evidence"),
        "license_list_ambiguous": comps.filter("licences > 1"),
        "license_name_not_spdx": comps.filter("named_licence"),
        "nesting_depth_exceeded": comps.filter(F.col("depth") >= DEPTH).filter("inner > 0"),
        "relationship_unresolved": rels.filter("NOT resolved AND relationship = 'DEPENDS_ON'").join(comps.select("document_id", F.col("element_id").alias("from_element")).distinct(), ["document_id", "from_element"], "left_semi").select("document_id").unionByName(refs.select("document_id")),
        "root_missing": parsed.filter("d.metadata.component IS NULL"),
    }
    out = None
    for code, rows in each.items():
        one = rows.select("document_id", F.lit(code).alias("code"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("document_id", "code").agg(F.count("*").alias("n"))
