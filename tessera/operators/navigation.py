"""Precise navigation over symbol occurrences: what stands at a position, where a symbol is defined, what encloses a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import written

DEFINITION = 1
#: Lines with a definition around them, of some 100 bytes, that are broadcast.
FEW = 200_000


def _before(line: str, char: str, other_line: str, other_char: str, strict: bool = False):
    same = F.col(char) < F.col(other_char) if strict else F.col(char) <= F.col(other_char)
    return (F.col(line) < F.col(other_line)) | ((F.col(line) == F.col(other_line)) & same)


#: Lines of the smallest bins, how many of them one of the next level holds, and levels: more than any file has lines.
BIN, WIDER, LEVELS = 32, 8, 9


def _size(level: Column) -> Column:
    return F.lit(BIN) * F.pow(F.lit(WIDER), level).cast("long")


def _binned(rows: DataFrame, first: str, last: str) -> DataFrame:
    """rows with level and bin: each range goes to the one bin, the smallest, that holds its first and its last line."""
    levels = F.array(*[F.lit(k) for k in range(LEVELS)])
    level = F.coalesce(F.element_at(F.filter(levels, lambda k: F.floor(F.col(first) / _size(k)) == F.floor(F.col(last) / _size(k))), 1), F.lit(LEVELS))
    return rows.withColumn("level", level).withColumn("bin", F.floor(F.col(first) / _size(F.col("level"))))


def _probing(rows: DataFrame, line: str) -> DataFrame:
    """rows once for each level, with the bin that its line has there: a range that holds the line lies in one of these bins."""
    return rows.withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(LEVELS + 1)]))).withColumn("bin", F.floor(F.col(line) / _size(F.col("level"))))


def occurrence_at(occurrences: DataFrame, req: DataFrame) -> DataFrame:
    """The innermost occurrence of each request's position: latest start, then smallest end.

    occurrences: upload_id, path, start_line, start_character, end_line, end_character, symbol, roles.
    req: query_id, upload_id, path, line, character.
    """
    hit = _probing(req, "line").join(_binned(occurrences, "start_line", "end_line"), ["upload_id", "path", "level", "bin"]).filter(_before("start_line", "start_character", "line", "character") & _before("line", "character", "end_line", "end_character", strict=True))
    w = Window.partitionBy("query_id").orderBy(F.desc("start_line"), F.desc("start_character"), "end_line", "end_character", "symbol")
    return hit.withColumn("r", F.row_number().over(w)).filter("r = 1").select("query_id", "symbol", "start_line", "start_character")


def locations(occurrences: DataFrame, relationships: DataFrame, req: DataFrame, operation: str) -> DataFrame:
    """Definitions, references or implementations of each request's symbol: distinct places.

    relationships: source_symbol, target_symbol, is_definition, is_reference, is_implementation. req: query_id, symbol.
    Related symbols are reached in one hop; definitions carry the role bit, references lack it.
    """
    role = F.col("roles").bitwiseAND(DEFINITION) != 0
    out = {"definitions": ("is_definition",), "references": ("is_reference",), "implementations": ()}[operation]
    into = {"definitions": (), "references": ("is_reference",), "implementations": ("is_implementation",)}[operation]
    targets = req if operation != "implementations" else req.limit(0)
    for flag in out:
        targets = targets.unionByName(req.join(relationships.filter(flag), F.col("symbol") == F.col("source_symbol")).select("query_id", F.col("target_symbol").alias("symbol")))
    for flag in into:
        targets = targets.unionByName(req.join(relationships.filter(flag), F.col("symbol") == F.col("target_symbol")).select("query_id", F.col("source_symbol").alias("symbol")))
    found = targets.distinct().join(occurrences, "symbol")
    if operation != "implementations":
        found = found.filter(role if operation == "definitions" else ~role)
    return found.select("query_id", "upload_id", "path", "start_line", "start_character", "symbol").distinct()


def enclosing(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """For each reference the innermost definition whose range contains it; a definition's own name is not inside it.

    references: reference_id, upload_id, path, line, and character where there is one. definitions: definition_id, upload_id, path,
    from_line, to_line, and name_line, name_character where there are such.
    """
    place = ["upload_id", "path", "line"]
    named = "character" in references.columns and "name_line" in definitions.columns
    own = references.select("reference_id", *place, *(["character"] if named else []))
    hit = own.join(_innermost(own.select(*place), definitions), place)
    if named:
        # what is innermost at a line is so at all its places, but for those that are its own name: these are asked one by one
        name = (F.col("line") == F.col("name_line")) & (F.col("character") == F.col("name_character"))
        at = definitions.select("upload_id", "path", F.col("name_line").alias("line"), F.col("name_character").alias("character")).distinct()
        there = own.join(at, [*place, "character"], "left_semi")
        ranges = definitions.groupBy("upload_id", "path", "from_line", "to_line", "name_line", "name_character").agg(F.max("definition_id").alias("definition_id"))
        probes = there.select(*place, "character").distinct()
        other = _probing(probes, "line").join(_binned(ranges, "from_line", "to_line"), ["upload_id", "path", "level", "bin"]).filter("from_line <= line AND line <= to_line").filter(~F.coalesce(name, F.lit(False)))
        other = there.join(other.groupBy(*place, "character").agg(_best()), [*place, "character"])
        hit = hit.join(at, [*place, "character"], "left_anti").select("reference_id", "b").unionByName(other.select("reference_id", "b"))
    best = hit.groupBy("reference_id").agg(F.max("b").alias("b"))
    return best.select("reference_id", F.col("b.definition_id").alias("definition_id"))


def _best() -> Column:
    """Of ranges that hold a line the latest start, then the smallest end, then the largest id."""
    return F.max(F.struct("from_line", (-F.col("to_line")).alias("to"), "definition_id")).alias("b")


def _innermost(places: DataFrame, definitions: DataFrame) -> DataFrame:
    """(upload_id, path, line, b): the innermost definition around each place. A line is asked once, however many places are on it, and a
    range once, however many definitions have it."""
    ranges = definitions.groupBy("upload_id", "path", "from_line", "to_line").agg(F.max("definition_id").alias("definition_id"))
    hit = _probing(places.distinct(), "line").join(_binned(ranges, "from_line", "to_line"), ["upload_id", "path", "level", "bin"]).filter("from_line <= line AND line <= to_line")
    return hit.groupBy("upload_id", "path", "line").agg(_best())


def visible(found: DataFrame, req: DataFrame, local: Column) -> DataFrame:
    """Locations without local symbols of other documents. req: query_id, upload_id, path of the place that asks."""
    own = req.select("query_id", F.col("upload_id").alias("_u"), F.col("path").alias("_p"))
    return found.join(own, "query_id").filter(~local | ((F.col("upload_id") == F.col("_u")) & (F.col("path") == F.col("_p")))).drop("_u", "_p")


def symbol_graph(occurrences: DataFrame, relationships: DataFrame, symbols: DataFrame, kinds: dict[str, str], legacy: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from symbol rows. occurrences: upload_id, path, start_line, start_character, end_line, symbol, roles, to_line (where a
    definition's body ends, null without one); relationships: upload_id, source_symbol, target_symbol and is_ flags; symbols: symbol, kind.

    nodes: (upload_id, occurrence, kind, path, line): a file for each path, a symbol at its first definition. edges, each once:
    contains from the symbol whose descriptor is the longest proper prefix, else from the file; imports from a file to a module
    that it refers to; references from the innermost definition around, else from the file; implements, type_of and
    references of relationships between known symbols. In the legacy form there are no imports, implements are extends as
    well where both ends are types, and type_of is left out. kinds: symbol kind → node kind; others are variables.
    """
    first = F.min(F.struct("path", F.col("start_line").alias("line"), "start_character", "to_line")).alias("d")
    defined = F.col("roles").bitwiseAND(DEFINITION) != 0
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    sym = occurrences.filter(defined).groupBy("upload_id", "symbol").agg(first).join(symbols, "symbol", "left")
    sym = sym.select("upload_id", "symbol", F.coalesce(F.try_element_at(table, F.col("kind")), F.lit("variable")).alias("kind"), "d.path", "d.line", "d.to_line")
    file_of = lambda path: F.concat(F.lit("file:"), path)
    nodes = sym.select("upload_id", F.col("symbol").alias("occurrence"), "kind", "path", "line")
    nodes = nodes.unionByName(occurrences.select("upload_id", "path").distinct().select("upload_id", file_of(F.col("path")).alias("occurrence"), F.lit("file").alias("kind"), "path", F.lit(0).alias("line")))
    edge = lambda df, source, kind, target: df.select("upload_id", source.alias("source"), kind.alias("kind"), target.alias("target"))
    above = F.regexp_replace("symbol", r"[^#./]+[#./]*$", "")
    up = sym.withColumn("above", above).join(sym.select("upload_id", F.col("symbol").alias("above"), F.lit(True).alias("_known")), ["upload_id", "above"], "left")
    out = edge(up, F.when(F.col("_known"), F.col("above")).otherwise(file_of(F.col("path"))), F.lit("contains"), F.col("symbol"))
    own = sym.select("upload_id", "symbol", "kind")
    r = relationships.join(own.toDF("upload_id", "source_symbol", "_a"), ["upload_id", "source_symbol"]).join(own.toDF("upload_id", "target_symbol", "_b"), ["upload_id", "target_symbol"])
    types = F.col("_a").isin("class", "interface") & F.col("_b").isin("class", "interface")
    says = [F.when(F.col("is_implementation"), "implements"), F.when(F.col("is_reference"), "references"), F.when(F.col("is_implementation") & types, "extends") if legacy else F.when(F.col("is_type_definition"), "type_of")]
    r = r.select("upload_id", "source_symbol", F.explode(F.array_compact(F.array(*says))).alias("kind"), "target_symbol")
    out = out.unionByName(edge(r.filter("kind <> 'references'"), F.col("source_symbol"), F.col("kind"), F.col("target_symbol"))).distinct()

    # references: what is around a line is found once for each line and goes to the rows, which are dealt by symbol only when they are distinct
    use = occurrences.filter(~defined).select("upload_id", "path", F.col("start_line").alias("line"), "symbol")
    ranges = sym.filter("to_line IS NOT NULL").select(F.col("symbol").alias("definition_id"), "upload_id", "path", F.col("line").alias("from_line"), "to_line")
    place = ["upload_id", "path", "line"]
    inside = written(_innermost(use.select(*place), ranges).select(*place, F.col("b.definition_id").alias("inside")))
    ref = use.join(F.broadcast(inside) if inside.limit(FEW + 1).count() <= FEW else inside, place, "left")
    ref = ref.select("upload_id", "symbol", F.coalesce("inside", file_of(F.col("path"))).alias("source"), "path", F.lit(False).alias("told"))
    ref = ref.unionByName(r.filter("kind = 'references'").select("upload_id", F.col("target_symbol").alias("symbol"), F.col("source_symbol").alias("source"), F.lit(None).cast("string").alias("path"), F.lit(True).alias("told"))).distinct()
    told, module = F.col("told"), F.lit(not legacy) & (F.col("kind") == "module")
    ref = ref.join(own, ["upload_id", "symbol"]).filter(told | module | (F.col("source") != F.col("symbol")))
    ref = edge(ref, F.when(module & ~told, file_of(F.col("path"))).otherwise(F.col("source")), F.when(module & ~told, "imports").otherwise("references"), F.col("symbol"))
    return nodes, ref.distinct().unionByName(out)
