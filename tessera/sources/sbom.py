"""SBOM documents as tables: SPDX 2.3 JSON to components, relationships and warnings, and back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import normalise
from ..shipping import written
from .purl import parse_purl

SPDX = """spdxVersion string, SPDXID string, name string, documentNamespace string, dataLicense string,
creationInfo struct<created: string, creators: array<string>>, documentDescribes array<string>,
packages array<struct<SPDXID: string, name: string, versionInfo: string, licenseDeclared: string, licenseConcluded: string, supplier: string,
  externalRefs: array<struct<referenceCategory: string, referenceType: string, referenceLocator: string>>, checksums: array<struct<algorithm: string, checksumValue: string>>>>,
relationships array<struct<spdxElementId: string, relationshipType: string, relatedSpdxElement: string>>"""


def detect(body: Column) -> Column:
    """spdx, cyclonedx or unknown, by the marks of a JSON object."""
    opened = F.ltrim(body).startswith("{")
    return F.when(opened & F.get_json_object(body, "$.spdxVersion").isNotNull(), "spdx").when(opened & F.get_json_object(body, "$.bomFormat").isNotNull(), "cyclonedx").otherwise("unknown")


def store(documents: DataFrame, body: str = "body") -> DataFrame:
    """(sha256, body, n): identical bodies share one row, named by the digest of their bytes; null counts as empty."""
    text = F.coalesce(F.col(body), F.lit(""))
    return documents.select(F.sha2(text, 256).alias("sha256"), text.alias("body")).groupBy("sha256").agg(F.first("body").alias("body"), F.count("*").alias("n"))


def parse(documents: DataFrame) -> DataFrame:
    """documents (document_id, body) with the parsed struct d; bodies that aren't SPDX 2.3 are left out."""
    d = documents.withColumn("d", F.from_json("body", SPDX)).filter(F.upper("d.spdxVersion") == "SPDX-2.3")
    return d.select("document_id", "d", F.coalesce(F.nullif("d.SPDXID", F.lit("")), F.lit("SPDXRef-DOCUMENT")).alias("root_id"))


def components(parsed: DataFrame) -> DataFrame:
    """One row per package, with a document-local id where its own is missing or taken, and the first purl."""
    p = parsed.select("document_id", F.posexplode("d.packages").alias("ordinal", "p"))
    own = F.coalesce(F.nullif("p.SPDXID", F.lit("")), F.concat(F.lit("SPDXRef-missing-"), F.col("ordinal").cast("string")))
    p = p.withColumn("own", own).withColumn("no", F.row_number().over(Window.partitionBy("document_id", "own").orderBy("ordinal")))
    element = F.when(F.col("no") > 1, F.concat("own", F.lit("#duplicate-"), F.col("ordinal").cast("string"))).otherwise(F.col("own"))
    purl = F.filter("p.externalRefs", lambda r: F.lower(r["referenceType"]) == "purl")
    return p.select(
        "document_id", "ordinal", element.alias("element_id"), F.coalesce(F.nullif("p.name", F.lit("")), element).alias("name"), F.col("p.versionInfo").alias("version"),
        F.try_element_at(purl, F.lit(1))["referenceLocator"].alias("purl"), F.coalesce(F.size(purl), F.lit(0)).alias("purls"), F.col("p.licenseDeclared").alias("license_declared"), F.col("p.licenseConcluded").alias("license_concluded"), (F.col("no") > 1).alias("duplicate"), F.coalesce("p.name", F.lit("")).alias("given_name"), F.col("p.SPDXID").alias("given_id"),
    )


def relationships(parsed: DataFrame, comps: DataFrame) -> DataFrame:
    """Every relationship with its direction; resolved when both ends are elements of the document (or nothing is asserted)."""
    r = parsed.select("document_id", "root_id", F.explode("d.relationships").alias("r"))
    r = r.select("document_id", "root_id", F.col("r.spdxElementId").alias("from_element"), F.upper(F.trim(F.coalesce("r.relationshipType", F.lit("")))).alias("relationship"), F.col("r.relatedSpdxElement").alias("to_element"))
    known = comps.select("document_id", "element_id").distinct()
    r = r.join(known.select("document_id", F.col("element_id").alias("from_element"), F.lit(True).alias("_f")), ["document_id", "from_element"], "left")
    r = r.join(known.select("document_id", F.col("element_id").alias("to_element"), F.lit(True).alias("_t")), ["document_id", "to_element"], "left")
    start = F.col("_f").isNotNull() | (F.col("from_element") == F.col("root_id"))
    end = F.col("_t").isNotNull() | (F.col("to_element") == F.col("root_id")) | F.col("to_element").isin("NOASSERTION", "NONE")
    resolved = F.coalesce(start & end & (F.col("relationship") != ""), F.lit(False))
    return r.select("document_id", "from_element", "relationship", "to_element", "root_id", resolved.alias("resolved"))


def roots(parsed: DataFrame, comps: DataFrame, rels: DataFrame) -> DataFrame:
    """(document_id, element_id) of packages that the document describes, by either way of saying so."""
    told = parsed.select("document_id", F.explode("d.documentDescribes").alias("element_id"))
    told = told.unionByName(rels.filter("relationship = 'DESCRIBES' AND from_element = root_id").select("document_id", F.col("to_element").alias("element_id")))
    told = told.unionByName(rels.filter("relationship = 'DESCRIBED_BY' AND to_element = root_id").select("document_id", F.col("from_element").alias("element_id")))
    return told.distinct().join(comps.select("document_id", "element_id"), ["document_id", "element_id"], "left_semi")


def warnings(parsed: DataFrame, comps: DataFrame, rels: DataFrame) -> DataFrame:
    """(document_id, code, n): structural problems, counted."""
    parsed, comps, rels = written(parsed), written(comps), written(rels)  # each is read by many checks
    p = comps.withColumn("u", parse_purl(F.col("purl")))
    created = F.nullif(F.col("d.creationInfo.created"), F.lit(""))
    told = parsed.select("document_id", "root_id", F.explode("d.documentDescribes").alias("element_id")).unionByName(rels.filter("relationship = 'DESCRIBES' AND from_element = root_id").select("document_id", "root_id", F.col("to_element").alias("element_id"))).unionByName(rels.filter("relationship = 'DESCRIBED_BY' AND to_element = root_id").select("document_id", "root_id", F.col("from_element").alias("element_id")))
    known = comps.select("document_id", "element_id").distinct()
    each = [
        parsed.filter(created.isNotNull() & F.try_to_timestamp(created).isNull()).select("document_id", F.lit("created_invalid").alias("code")),
        parsed.filter(~F.coalesce(F.exists("d.creationInfo.creators", lambda c: F.trim(c).startswith("Tool:")), F.lit(False))).select("document_id", F.lit("creator_tool_missing").alias("code")),
        comps.filter("given_name = ''").select("document_id", F.lit("package_name_missing").alias("code")),
        p.filter("purl IS NOT NULL AND u IS NULL").select("document_id", F.lit("package_purl_invalid").alias("code")),
        p.filter("version <> u.version").select("document_id", F.lit("package_version_mismatch").alias("code")),
        told.filter("element_id = root_id").select("document_id", F.lit("root_is_document").alias("code")),
        told.filter("element_id <> root_id").join(known, ["document_id", "element_id"], "left_anti").select("document_id", F.lit("root_unresolved").alias("code")),
        rels.filter("relationship = '' OR coalesce(from_element, '') = '' OR coalesce(to_element, '') = ''").select("document_id", F.lit("relationship_incomplete").alias("code")),
        parsed.select("document_id").join(roots(parsed, comps, rels).select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.lit("root_missing").alias("code")),
        parsed.filter(F.col("d.SPDXID").isNull() | (F.col("d.SPDXID") == "")).select("document_id", F.lit("document_id_missing").alias("code")),
        parsed.filter(F.col("d.creationInfo.created").isNull()).select("document_id", F.lit("created_missing").alias("code")),
        comps.filter(F.coalesce("given_id", F.lit("")) == "").select("document_id", F.lit("package_id_missing").alias("code")),
        comps.filter("duplicate").select("document_id", F.lit("package_id_duplicate").alias("code")),
        comps.filter(F.coalesce("version", F.lit("")) == "").select("document_id", F.lit("package_version_missing").alias("code")),
        comps.filter("purls = 0").select("document_id", F.lit("package_purl_missing").alias("code")),
        comps.filter("purls > 1").select("document_id", F.lit("package_purl_multiple").alias("code")),
        rels.filter("NOT resolved AND relationship <> '' AND coalesce(from_element, '') <> '' AND coalesce(to_element, '') <> ''").select("document_id", F.lit("relationship_unresolved").alias("code")),
    ]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.groupBy("document_id", "code").agg(F.count("*").alias("n"))


#: Packages or relationships in one piece of an exported document, by their ordinals.
CHUNK = 500
DOCUMENT = "SPDXRef-DOCUMENT"
#: Elements with ids of their own, of some 100 bytes, that are broadcast.
FEW = 200_000


def element_ids(elements: DataFrame) -> DataFrame:
    """(document_id, element_id, spdx_id): ids with sanitised letters that stay unique within a document.

    elements: document_id, element_id, place (struct or number that orders the elements of a document). The first to ask for an id gets it,
    the next ones get the first free of id-2, id-3 and so on; the document's own id is taken. Only ids that are asked for more than once, and
    those that could be one of their numbered forms, are dealt with in order, each such family by itself.
    """
    each = elements.groupBy("document_id", "element_id").agg(F.min("place").alias("place")).withColumn("base", _base("element_id"))
    return each.join(_numbered(elements), ["document_id", "element_id"], "left").select("document_id", "element_id", F.coalesce("spdx_id", "base").alias("spdx_id"))


def _base(element: str) -> Column:
    clean = F.regexp_replace(element, "[^A-Za-z0-9.-]", "-")
    return F.when(F.col(element).startswith("SPDXRef-"), clean).otherwise(F.concat(F.lit("SPDXRef-"), clean))


def _small(df: DataFrame) -> DataFrame:
    """A stored table, broadcast where it has FEW rows or less."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _numbered(elements: DataFrame) -> DataFrame:
    """(document_id, element_id, spdx_id) of the elements whose families are dealt with in order, the only ones whose id may not be their
    base. Stored."""
    based = elements.withColumn("base", _base("element_id"))
    asked = based.groupBy("document_id", "base").agg(F.min("element_id").alias("lo"), F.max("element_id").alias("hi"))
    twice = _small(written(asked.filter((F.col("lo") != F.col("hi")) | (F.col("base") == DOCUMENT)).select("document_id", F.col("base").alias("family"))))
    # a base and what is left of it without each of its numbers at the end
    ends = F.size(F.split(F.regexp_extract("base", "(-[0-9]+)*$", 0), "-")) - 1
    stems = F.transform(F.sequence(F.lit(0), ends), lambda n: F.array_join(F.slice(F.split("base", "-"), F.lit(1), F.size(F.split("base", "-")) - n), "-"))
    # the elements of those families, then their first places
    shared = based.select("document_id", "element_id", "place", "base", F.explode(stems).alias("family")).join(twice, ["document_id", "family"])
    shared = shared.groupBy("document_id", "element_id", "base").agg(F.min("place").alias("place"), F.min_by("family", F.length("family")).alias("family"))

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = {DOCUMENT}, []
        for base in pdf.sort_values("rank")["base"]:
            name, n = base, 2
            while name in used:
                name, n = f"{base}-{n}", n + 1
            used.add(name)
            out.append(name)
        return pdf.sort_values("rank").assign(spdx_id=out)[["document_id", "element_id", "spdx_id"]]

    kind = elements.schema["document_id"].dataType.simpleString()
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("document_id", "family").orderBy("place", "element_id"))).drop("place")
    numbered = ranked.groupBy("document_id", "family").applyInPandas(number, f"document_id {kind}, element_id string, spdx_id string")
    return written(numbered)


def export_parts(comps: DataFrame, rels: DataFrame, header: dict[str, str]) -> DataFrame:
    """(document_id, section, chunk, text): SPDX 2.3 JSON documents in pieces; those of a document, in order, are its text.

    comps: document_id, ordinal, element_id, name, version, purl, license_raw, is_root. rels: document_id, ordinal, from_element, relationship,
    to_element, resolved. Roots are described by the document; of rels those that are resolved and don't describe follow, each with its
    type and both ends under their new ids. Licences that parse are declared in canonical form, others go to a comment. No row
    holds more than CHUNK ordinals of packages or relationships.
    """
    docs, packages, edges, (first, between, last) = _export_rows(comps, rels, header)

    def pieces(rows: DataFrame, section: int) -> DataFrame:
        at = F.struct("part", F.floor(F.col("ordinal") / CHUNK).alias("no"))
        by = rows.groupBy("document_id", at.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "json"))).alias("j"))
        first = by.groupBy("document_id").agg(F.min("chunk").alias("first"))
        text = F.array_join(F.transform("j", lambda x: x["json"]), ",")
        return by.join(first, "document_id").select("document_id", F.lit(section).alias("section"), "chunk", F.when(F.col("chunk") == F.col("first"), text).otherwise(F.concat(F.lit(","), text)).alias("text"))

    none = F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("no"))
    fixed = lambda section, text: docs.select("document_id", F.lit(section).alias("section"), none.alias("chunk"), text.alias("text"))
    out = fixed(0, first).unionByName(fixed(2, between)).unionByName(fixed(4, last))
    return out.unionByName(pieces(packages, 1)).unionByName(pieces(edges, 3))


def _export_rows(comps: DataFrame, rels: DataFrame, header: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame, tuple[Column, Column, Column]]:
    """(document_id) of all documents, then (document_id, part, ordinal, json) of packages and of relationships, and the texts before, between
    and behind them."""
    kept = rels.filter("resolved AND relationship NOT IN ('DESCRIBES', 'DESCRIBED_BY')")
    place = lambda section, end: F.struct(F.lit(section).alias("section"), F.col("ordinal").alias("ordinal"), F.lit(end).alias("end")).alias("place")
    elements = comps.select("document_id", "element_id", place(0, 0))
    for end, c in enumerate(("from_element", "to_element")):
        elements = elements.unionByName(kept.select("document_id", F.col(c).alias("element_id"), place(1, end)))
    ids = _small(_numbered(elements))
    comps = normalise(comps.filter("document_id IS NOT NULL AND element_id IS NOT NULL").join(ids, ["document_id", "element_id"], "left").withColumn("spdx_id", F.coalesce("spdx_id", _base("element_id"))), "license_raw")
    usable = F.col("expression_status").isin("parsed", "unknown_terms")
    package = F.struct(
        F.col("spdx_id").alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), F.lit("NOASSERTION").alias("licenseConcluded"), F.when(usable, F.col("expression")).otherwise("NOASSERTION").alias("licenseDeclared"),
        F.when(~usable & (F.trim("license_raw") != ""), F.concat(F.lit("producer declared (not an SPDX expression): "), F.col("license_raw"))).alias("licenseComments"),
        F.when(F.col("purl").isNotNull(), F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator")))).alias("externalRefs"),
    )
    edge = lambda a, t, b: F.to_json(F.struct(a.alias("spdxElementId"), t.alias("relationshipType"), b.alias("relatedSpdxElement"))).alias("json")
    end = lambda c: ids.select("document_id", F.col("element_id").alias(f"{c}_element"), F.col("spdx_id").alias(c))
    named = lambda c: F.coalesce(c, _base(f"{c}_element"))
    roots = comps.filter("is_root").select("document_id", F.lit(0).alias("part"), "ordinal", edge(F.lit(DOCUMENT), F.lit("DESCRIBES"), F.col("spdx_id")))
    links = kept.filter("document_id IS NOT NULL AND from_element IS NOT NULL AND to_element IS NOT NULL").join(end("from"), ["document_id", "from_element"], "left").join(end("to"), ["document_id", "to_element"], "left").select("document_id", F.lit(1).alias("part"), "ordinal", edge(named("from"), F.col("relationship"), named("to")))

    # the head is cut out of a document without packages and relationships, so that every value is escaped in one way
    empty = F.struct(
        F.lit("SPDX-2.3").alias("spdxVersion"), F.lit(DOCUMENT).alias("SPDXID"), F.lit(header["name"]).alias("name"), F.lit("CC0-1.0").alias("dataLicense"),
        F.struct(F.lit(header["created"]).alias("created"), F.array(F.lit(f"Tool: {header['tool']}")).alias("creators")).alias("creationInfo"),
    )
    packages = comps.select("document_id", F.lit(0).alias("part"), "ordinal", F.to_json(package).alias("json"))
    docs = comps.select("document_id").unionByName(kept.select("document_id")).distinct()
    return docs, packages, roots.unionByName(links), (F.concat(F.regexp_replace(F.to_json(empty), r"\}$", ""), F.lit(',"packages":[')), F.lit('],"relationships":['), F.lit("]}"))


def export(comps: DataFrame, rels: DataFrame, header: dict[str, str]) -> DataFrame:
    """(document_id, body): what export_parts gives in pieces as one text, for documents that fit into a row. Rows are dealt by document once."""
    _, packages, edges, (first, between, last) = _export_rows(comps, rels, header)
    rows = packages.select("document_id", F.lit(0).alias("section"), "part", "ordinal", "json").unionByName(edges.select("document_id", F.lit(1).alias("section"), "part", "ordinal", "json"))
    by = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("section", "part", "ordinal", "json"))).alias("p"))
    text = lambda no: F.array_join(F.transform(F.filter("p", lambda x: x["section"] == no), lambda x: x["json"]), ",")
    return by.select("document_id", F.concat(first, text(0), between, text(1), last).alias("body"))
