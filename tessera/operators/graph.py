"""Selectors and aggregates over code-graph facts: nodes, edges, files, unresolved references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relations in their rank order, kinds that contain others, kinds of wildcard search.
RELATIONS = ("contains", "calls", "imports", "exports", "extends", "implements", "references", "type_of", "returns", "instantiates", "overrides", "decorates", "navigates")
CONTAINERS = ("class", "interface", "struct", "union", "trait", "protocol", "module", "enum")

#: Fixed value: file names that generators give.
GENERATED = (
    r"(\.pb\.go|\.pulsar\.go|_grpc\.pb\.go|_mock\.go|_mocks\.go|\.generated\.[jt]sx?|\.gen\.[jt]sx?|\.pb\.[jt]s|_pb\.[jt]s|_grpc_pb\.[jt]s|\.min\.m?js|_pb2(_grpc)?\.py|_pb2\.pyi|\.pb\.(cc|h)|\.g\.cs|Grpc\.cs"
    r"|OuterClass\.java|Grpc\.java|\.pb\.swift|\.g\.dart|\.freezed\.dart|\.pb\.dart|\.pbgrpc\.dart|\.chopper\.dart|\.generated\.rs)$|^mock_[^/]+\.go$"
)


def confident(least: float, column: str = "confidence") -> Column:
    """An edge without a confidence passes every threshold."""
    return F.col(column).isNull() | (F.col(column) >= least)


def relation_rank(kind: str = "kind") -> Column:
    return F.array_position(F.array(*map(F.lit, RELATIONS)), F.col(kind)).cast("int")


def select_entities(nodes: DataFrame, req: DataFrame) -> DataFrame:
    """Nodes that meet each request's non-null fields among occurrence, name, qualified_name, path and kind.

    req: query_id and those fields. Requests are told apart by their first usable field, so that each part is an
    equi-join; the other fields filter.
    """
    fields = ("occurrence", "qualified_name", "name", "path", "kind")
    r = req.select("query_id", *[F.col(f).alias(f"r_{f}") for f in fields])
    out = None
    for i, f in enumerate(fields):
        own = r.filter(F.col(f"r_{f}").isNotNull())
        for g in fields[:i]:
            own = own.filter(F.col(f"r_{g}").isNull())
        hit = own.join(nodes, F.col(f"r_{f}") == F.col(f))
        for g in fields[i + 1 :]:
            hit = hit.filter(F.col(f"r_{g}").isNull() | (F.col(f"r_{g}") == F.col(g)))
        hit = hit.select("query_id", *nodes.columns)
        out = hit if out is None else out.unionByName(hit)
    return out


def name_prefix(nodes: DataFrame, prefix: str, kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
    hit = nodes.filter(F.col("name").startswith(prefix))
    hit = hit.filter(F.col("kind").isin(kinds)) if kinds else hit
    return hit.orderBy("name", "occurrence").limit(limit)


def name_contains(nodes: DataFrame, part: str, exclude_prefix: str | None = None, limit: int = 30) -> DataFrame:
    """ASCII-folded substring, shortest names first."""
    folded = F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = nodes.filter(folded.contains(part.lower()))
    hit = hit.filter(~folded.startswith(exclude_prefix.lower())) if exclude_prefix else hit
    return hit.orderBy(F.char_length("name"), "name", "occurrence").limit(limit)


def wildcard(nodes: DataFrame, pattern: str, kinds: list[str]) -> DataFrame:
    """Qualified names that a pattern of * and ? matches as a whole; kind_rank is the kind's place in kinds."""
    import re

    regex = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([\\.^$|()\[\]{}+])", r"\\\1", c) for c in pattern) + "$"
    fixed = re.split(r"[*?]", pattern)[0]
    hit = nodes.filter(F.col("qualified_name").startswith(fixed) & F.col("qualified_name").rlike("(?s)" + regex) & F.col("kind").isin(kinds))
    return hit.withColumn("kind_rank", F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int"))


def exported_symbols(nodes: DataFrame) -> DataFrame:
    return nodes.filter("is_exported AND path IS NOT NULL").select("path", "line", "occurrence", "name", "kind")


def path_regex(pattern: str, anywhere: bool = False) -> str:
    """A path pattern as a regular expression: * and ? stay inside a folder, ** crosses folders.

    With anywhere, as ignore files read it: a pattern without an inner slash fits at any depth, and whatever lies under
    what fits.
    """
    import re

    body, at, p = "", 0, pattern.strip("/") if anywhere else pattern
    while at < len(p):
        if p.startswith("**/", at):
            body, at = body + "(?:.*/)?", at + 3
        elif p.startswith("**", at):
            body, at = body + ".*", at + 2
        else:
            c = p[at]
            body, at = body + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.sub(r"([\\.^$|()\[\]{}+*?])", r"\\\1", c)), at + 1
    if anywhere:
        return ("^" if "/" in pattern.strip("/") or pattern.startswith("/") else "^(?:.*/)?") + body + "(?:/.*)?$"
    return f"^{body}$"


def files_under(files: DataFrame, path: str, how: str = "prefix") -> DataFrame:
    """Files by exact path, in a directory, prefix (the path or what is under it), glob (as ignore files) or pattern, with the total on each row."""
    folder = path.rstrip("/") + "/"
    keep = {
        "exact": F.col("path") == path,
        "directory": F.col("path").startswith(folder) & ~F.contains(F.substring("path", len(folder) + 1, 1 << 30), F.lit("/")),
        "prefix": (F.col("path") == path) | F.col("path").startswith(folder),
        "glob": F.col("path").rlike(path_regex(path, anywhere=True)),
        "pattern": F.col("path").rlike(path_regex(path)),
    }[how]
    own = files.filter(keep)
    return own.crossJoin(F.broadcast(own.agg(F.count("*").alias("total"))))


def inventory_by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def inventory_tree(files: DataFrame, depth: int) -> DataFrame:
    """Every directory to the depth with the number of files under it."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(depth))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.filter(F.size(parts) > 1).select(F.explode(dirs).alias("directory")).groupBy("directory").agg(F.count("*").alias("files"))


def module_structure(files: DataFrame) -> DataFrame:
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    return files.groupBy(directory.alias("directory")).agg(F.sort_array(F.collect_list("path")).alias("paths"))


def stats(nodes: DataFrame, edges: DataFrame, files: DataFrame, unresolved: DataFrame) -> DataFrame:
    each = [df.select(F.lit(c).alias("category"), F.col(v).alias("value")) for c, df, v in (("node", nodes, "kind"), ("edge", edges, "kind"), ("file", files, "language"))]
    each.append(unresolved.select(F.lit("unresolved").alias("category"), F.lit("all").alias("value")))
    out = [e.groupBy("category", "value").agg(F.count("*").alias("n")) for e in each]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def fan(edges: DataFrame, wanted: DataFrame, end: str) -> DataFrame:
    """Edges per requested target (fan-in) or source (fan-out); wanted: occurrence."""
    return edges.join(wanted.select(F.col("occurrence").alias(end)), end, "left_semi").groupBy(F.col(end).alias("occurrence")).agg(F.count("*").alias("n"))


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """incoming, outgoing, calls out, callers and children of each node, in one pass over both ends of the edges."""
    call, inside = F.col("kind") == "calls", F.col("kind") == "contains"
    ends = edges.select(F.col("source").alias("occurrence"), F.lit(0).alias("i"), F.lit(1).alias("o"), call.cast("int").alias("c"), F.lit(0).alias("r"), inside.cast("int").alias("h")).unionByName(
        edges.select(F.col("target").alias("occurrence"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("c"), call.cast("int").alias("r"), F.lit(0).alias("h"))
    )
    names = {"i": "incoming", "o": "outgoing", "c": "calls", "r": "callers", "h": "children"}
    sums = ends.groupBy("occurrence").agg(*[F.sum(k).alias(v) for k, v in names.items()])
    return nodes.select("occurrence").join(sums, "occurrence", "left").select("occurrence", *[F.coalesce(v, F.lit(0)).cast("long").alias(v) for v in names.values()])


def ambiguous_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Names of more than one node of which one has an incoming edge other than contains."""
    used = edges.filter("kind <> 'contains'").select(F.col("target").alias("occurrence"), F.lit(True).alias("used")).distinct()
    by = nodes.join(used, "occurrence", "left").groupBy("name").agg(F.count("*").alias("nodes"), F.bool_or(F.coalesce("used", F.lit(False))).alias("used"))
    return by.filter("nodes > 1 AND used").select("name", "nodes")


def languages_with_exports(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("language").agg(F.coalesce(F.bool_or("is_exported"), F.lit(False)).alias("exports"))


def unresolved_among(unresolved: DataFrame, names: DataFrame) -> DataFrame:
    seen = unresolved.select(F.explode(F.array("name", "name_tail")).alias("name")).filter("name IS NOT NULL")
    return names.join(seen, "name", "left_semi").select("name").distinct()


def top_depended_on(edges: DataFrame, k: int) -> DataFrame:
    by = edges.filter("kind <> 'contains' AND source <> target").groupBy("target").agg(F.countDistinct("source").alias("dependents"))
    return by.orderBy(F.desc("dependents"), "target").limit(k)


def top_calling_files(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Score of a file: calls and instantiations out of it times one more than the other files that it reaches."""
    path_of = nodes.filter("path IS NOT NULL").select("occurrence", "path")
    s, t = path_of.toDF("source", "from_path"), path_of.toDF("target", "to_path")
    moved = edges.filter("kind <> 'contains'").join(s, "source").join(t, "target", "left")
    by = moved.groupBy("from_path").agg(
        F.count_if(F.col("kind").isin("calls", "instantiates")).alias("calls"),
        F.countDistinct(F.when(F.col("to_path") != F.col("from_path"), F.col("to_path"))).alias("reaches"),
    )
    return by.select(F.col("from_path").alias("path"), "calls", "reaches", (F.col("calls") * (1 + F.col("reaches"))).alias("score")).orderBy(F.desc("score"), "path").limit(k)


def module_links(edges: DataFrame, modules: DataFrame, least: float, kinds: list[str]) -> DataFrame:
    """Edges between modules by kind: certain and uncertain ones by confidence (none counts as 1), and declared ones.

    modules: occurrence, module.
    """
    s, t = modules.toDF("source", "source_module"), modules.toDF("target", "target_module")
    sure = F.coalesce("confidence", F.lit(1.0)) >= least
    moved = edges.filter(F.col("kind").isin(kinds)).join(s, "source").join(t, "target").filter("source_module <> target_module")
    return moved.groupBy("source_module", "target_module", "kind").agg(F.count_if(sure).alias("certain"), F.count_if(~sure).alias("uncertain"), F.count_if(declared()).alias("declared"))


def declared() -> Column:
    """Whether an edge was declared rather than guessed."""
    return F.col("reason").isin("import", "qualified-name") | F.col("kind").isin("extends", "implements") | ((F.col("reason") == "instance-method") & (F.coalesce("confidence", F.lit(1.0)) >= 0.9))


def top_pairs(edges: DataFrame, modules: DataFrame, n: int, kinds: list[str]) -> DataFrame:
    """The n strongest pairs of each module link over the pair kinds: most declared edges first, then most edges, then by name."""
    s, t = modules.toDF("source", "source_module"), modules.toDF("target", "target_module")
    by = edges.filter(F.col("kind").isin(kinds)).join(s, "source").join(t, "target").filter("source_module <> target_module").groupBy("source_module", "target_module", "source", "target").agg(F.count_if(declared()).alias("declared"), F.count("*").alias("n"))
    w = Window.partitionBy("source_module", "target_module").orderBy(F.desc("declared"), F.desc("n"), F.lower("source"), F.lower("target"), "source", "target")
    return by.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def unresolved_of_files(unresolved: DataFrame, nodes: DataFrame) -> DataFrame:
    return unresolved.join(nodes.select(F.col("occurrence").alias("source"), "path"), "source").select("path", "line", "occurrence", "name", "kind")


def unresolved_of(unresolved: DataFrame, req: DataFrame) -> DataFrame:
    """References out of nodes that nothing resolved, in ordinal order. req: query_id, source."""
    w = Window.partitionBy("query_id").orderBy("ordinal")
    return req.join(unresolved, "source").withColumn("no", F.row_number().over(w)).select("query_id", "occurrence", "name", "no")


def generated_files(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if("generated").alias("generated"), F.count("*").alias("total"))


def overview_counts(by_category: dict[str, DataFrame]) -> DataFrame:
    """(category, status, n) of several tables with a status each."""
    out = None
    for category, rows in by_category.items():
        one = rows.select(F.lit(category).alias("category"), "status")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("category", "status").agg(F.count("*").alias("n"))


def classify_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Generated by name or flag; ambient: only type declarations, no calls out, nothing comes in from other files."""
    types = ("class", "interface", "enum", "type_alias", "struct", "trait", "protocol")
    own = nodes.filter("kind <> 'file' AND path IS NOT NULL").groupBy("path").agg(F.bool_and(F.col("kind").isin(*types)).alias("only_types"))
    at = nodes.filter("path IS NOT NULL").select("occurrence", "path")
    calls = edges.filter(F.col("kind").isin("calls", "instantiates")).join(at.toDF("source", "path"), "source").select("path", F.lit(True).alias("calls")).distinct()
    both = edges.filter("kind <> 'contains'").join(at.toDF("source", "from_path"), "source").join(at.toDF("target", "path"), "target")
    entered = both.filter("from_path <> path").select("path", F.lit(True).alias("entered")).distinct()
    out = files.join(own, "path", "left").join(calls, "path", "left").join(entered, "path", "left")
    generated = F.coalesce("generated", F.lit(False)) | F.col("path").rlike(GENERATED)
    return out.select("path", generated.alias("generated"), (F.coalesce("only_types", F.lit(False)) & F.col("calls").isNull() & F.col("entered").isNull()).alias("ambient"))


def by_status(rows: DataFrame, column: str, states: list[str]) -> DataFrame:
    """Counts for a fixed list of states, zero where there is none."""
    known = rows.sparkSession.createDataFrame([(s,) for s in states], f"{column} string")
    return F.broadcast(known).join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def subtype_counts(edges: DataFrame, polymorphic: int = 8) -> DataFrame:
    """Per type: distinct subtypes, and implementers (subtypes that never extend it); polymorphic from so many on."""
    by = edges.filter("kind IN ('extends', 'implements')").groupBy("target", "source").agg(F.bool_or(F.col("kind") == "extends").alias("extends"))
    out = by.groupBy("target").agg(F.count("*").alias("subtypes"), F.count_if(~F.col("extends")).alias("implementers"))
    return out.withColumn("polymorphic", F.col("implementers") >= polymorphic)


def neighbors(edges: DataFrame, roots: DataFrame, direction: str, kinds: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """One row per edge of each request's root; roots: query_id, root. direction: outgoing or incoming."""
    own, far = ("source", "target") if direction == "outgoing" else ("target", "source")
    e = edges.filter(confident(least))
    e = e.filter(F.col("kind").isin(kinds)) if kinds else e
    return roots.select("query_id", F.col("root").alias(own)).join(e, own).select("query_id", F.col(far).alias("neighbor"), "kind", F.col("occurrence").alias("edge"), "confidence")


def usages(edges: DataFrame, roots: DataFrame) -> DataFrame:
    return neighbors(edges, roots, "incoming").withColumn("rank", relation_rank())


def filtered_subgraph(nodes: DataFrame, edges: DataFrame, keep: Column) -> DataFrame:
    """Edges with both ends among the kept nodes."""
    own = nodes.filter(keep).select("occurrence")
    return edges.join(own.toDF("source"), "source", "left_semi").join(own.toDF("target"), "target", "left_semi").select("occurrence", "source", "target", "kind")


def content_hash(rows: DataFrame, by: list[str], columns: list[str] | None = None, least: int = 2) -> DataFrame:
    """Order-free digest of each group's rows: (by, digest, rows).

    A row's digest is that of its canonical JSON (columns sorted by name, nulls left out). Digests fold in two levels:
    rows into at most 16 ** least buckets by the first hexadecimal digits of their digest, each the count and the sums of the
    digest's four 64-bit words modulo 2 ** 64; then the buckets in order. Sums don't mind the order, so that no task ever
    holds a group's rows.
    """
    cols = sorted(columns or [c for c in rows.columns if c not in by])
    row = F.sha2(F.to_json(F.struct(*cols)), 256)
    word = lambda i: F.conv(F.substring("_h", 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")
    buckets = rows.select(*by, row.alias("_h")).groupBy(*by, F.substring("_h", 1, least).alias("_b")).agg(F.count("*").alias("_n"), *[F.sum(word(i)).alias(f"_w{i}") for i in range(4)])
    wrap = lambda i: (F.col(f"_w{i}") % F.lit(str(1 << 64)).cast("decimal(38,0)")).cast("decimal(20,0)").cast("string")
    part = F.concat_ws(":", "_b", F.col("_n").cast("string"), *[wrap(i) for i in range(4)])
    return buckets.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), ","), 256).alias("digest"), F.sum("_n").alias("rows"))
