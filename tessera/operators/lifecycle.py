"""Generations and repositories over time: which snapshot answers, what is stale, what may go; packages and symbols across repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import durable


def active_generation(generations: DataFrame) -> DataFrame:
    """Per repository the generation at its indexed commit: published ones before derived ones, then the newest."""
    w = Window.partitionBy("repository_id").orderBy(F.when(F.col("source") == "external", 0).otherwise(1), F.desc("id"))
    return generations.filter("at_indexed_commit").withColumn("r", F.row_number().over(w)).filter("r = 1").select("repository_id", "id", "source")


def manifest_precedence(manifests: DataFrame) -> DataFrame:
    """(repository_id, id, rank): the manifest that answers. manifests: repository_id, id, schema_version, source.

    External ones of version 2 come first, then version 1 not derived from symbols, other ones of version 2, the rest; then the newest.
    """
    v2, scip = F.col("schema_version") == 2, F.col("source") == "scip"
    rank = F.when(v2 & (F.col("source") == "external"), 0).when(~v2 & ~scip, 1).when(v2, 2).otherwise(3)
    w = Window.partitionBy("repository_id").orderBy("rank", F.desc("id"))
    return manifests.withColumn("rank", rank).withColumn("r", F.row_number().over(w)).filter("r = 1").select("repository_id", "id", "rank")


def readiness(requested: DataFrame, generations: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(repository_id, reason, n): repositories without any graph, and those whose graph isn't at the indexed commit.

    selected repositories (repository_id) have a row of their own, the others are counted together with a null id.
    """
    has = generations.groupBy("repository_id").agg(F.bool_or("at_indexed_commit").alias("ready"))
    why = F.when(F.col("ready").isNull(), "graph_missing").when(~F.col("ready"), "graph_not_ready")
    rows = requested.join(has, "repository_id", "left").withColumn("reason", why).filter("reason IS NOT NULL")
    own = F.lit(None).cast("long")
    if selected is not None:
        rows = rows.join(selected.select("repository_id", F.lit(True).alias("_own")).distinct(), "repository_id", "left")
        own = F.when(F.col("_own"), F.col("repository_id"))
    return rows.select(own.alias("repository_id"), "reason").groupBy("repository_id", "reason").agg(F.count("*").alias("n"))


def repository_status(repositories: DataFrame, generations: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(id, state) with absent, stale or current for the graph, and symbol_state for symbol uploads where they are given.

    generations and symbols: repository_id, at_indexed_commit.
    """
    out = repositories.select("id")
    for name, rows in (("state", generations), ("symbol_state", symbols)):
        if rows is not None:
            has = rows.groupBy(F.col("repository_id").alias("id")).agg(F.bool_or("at_indexed_commit").alias("_r"))
            out = out.join(has, "id", "left").withColumn(name, F.when(F.col("_r").isNull(), "absent").when(F.col("_r"), "current").otherwise("stale")).drop("_r")
    return out


def reconcile(stored: DataFrame, upstream: DataFrame) -> DataFrame:
    """(id, action, head_changed): what an upstream list of repositories makes of the stored ones.

    stored: id, enabled, head; upstream: id, head. insert, enable, disable, update or keep; disabled ones that aren't upstream are
    kept. head_changed: the stored head is another one.
    """
    both = stored.select("id", "enabled", F.col("head").alias("old"), F.lit(True).alias("a")).join(upstream.select("id", F.col("head").alias("new"), F.lit(True).alias("b")), "id", "full")
    changed = F.col("a") & F.col("b") & ~F.col("old").eqNullSafe(F.col("new"))
    action = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), F.when(F.col("enabled"), "disable").otherwise("keep")).when(~F.col("enabled"), "enable").when(changed, "update").otherwise("keep")
    return both.select("id", action.alias("action"), F.coalesce(changed, F.lit(False)).alias("head_changed"))


def freshness_status(indexed: DataFrame, tree: DataFrame, ignored: Column | None = None) -> DataFrame:
    """(upload_id, status, modified, not_in_commit, not_indexed, unverifiable): whether an index still fits its commit.

    Both: upload_id, path, hash. Files that ignore rules drop are not missed in the index. Stale with any difference, else
    unverifiable with any file that has no hash, else fresh.
    """
    key = ["upload_id", "path"]
    both = indexed.select(*key, F.col("hash").alias("was"), F.lit(True).alias("a")).join(tree.select(*key, F.col("hash").alias("now"), F.lit(True).alias("b")), key, "full")
    skip = F.lit(False) if ignored is None else F.coalesce(ignored, F.lit(False))
    change = F.when(F.col("b").isNull(), "not_in_commit").when(F.col("a").isNull() & skip, "ignored").when(F.col("a").isNull(), "not_indexed").when(F.col("was").isNull() | F.col("now").isNull(), "unverifiable").when(F.col("was") != F.col("now"), "modified")
    n = [F.count_if(F.coalesce(change == c, F.lit(False))).alias(c) for c in ("modified", "not_in_commit", "not_indexed", "unverifiable")]
    by = both.groupBy("upload_id").agg(*n)
    status = F.when(F.col("modified") + F.col("not_in_commit") + F.col("not_indexed") > 0, "stale").when(F.col("unverifiable") > 0, "unverifiable").otherwise("fresh")
    return by.withColumn("status", status)


def freshness(indexed: DataFrame, tree: DataFrame) -> DataFrame:
    """Files that differ between an index and a commit's tree. Both: path, hash."""
    both = indexed.select("path", F.col("hash").alias("was"), F.lit(True).alias("a")).join(tree.select("path", F.col("hash").alias("now"), F.lit(True).alias("b")), "path", "full")
    change = F.when(F.col("b").isNull(), "not_in_commit").when(F.col("a").isNull(), "not_indexed").when(F.col("was").isNull() | F.col("now").isNull(), "unverifiable").when(F.col("was") != F.col("now"), "modified")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def outranked(legacy: DataFrame, active: DataFrame) -> DataFrame:
    """(id, repository_id): symbol-derived graphs of version 1 whose repository has an active symbol-derived one of version 2."""
    own = active.filter("schema_version = 2 AND source = 'scip' AND active").select("repository_id").distinct()
    return legacy.filter("schema_version = 1 AND source = 'scip'").join(own, "repository_id", "left_semi").select("id", "repository_id")


def prunable(generations: DataFrame, now: str, grace_days: int, also: DataFrame | None = None) -> DataFrame:
    """Retired generations whose grace is over, and those of also (id, repository_id), numbered oldest first per repository."""
    out = generations.filter(F.col("retired_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {grace_days} DAYS"))
    if also is not None:
        out = out.unionByName(generations.join(also.select("id"), "id", "left_semi")).dropDuplicates(["id"])
    return out.select("id", F.row_number().over(Window.partitionBy("repository_id").orderBy("retired_at", "id")).alias("no"), "repository_id")


def publish_outcome(staged: DataFrame, active: DataFrame) -> DataFrame:
    """What happens to each staged generation: unchanged, producer_changed, replaced or first."""
    a = active.select("repository_id", F.col("digest").alias("old"), F.col("producer").alias("old_producer"))
    what = F.when(F.col("old").isNull(), "first").when(F.col("old") == F.col("digest"), "unchanged").when(F.col("old_producer") != F.col("producer"), "producer_changed").otherwise("replaced")
    return staged.join(a, "repository_id", "left").select("id", what.alias("outcome"))


def pending_enrichment(components: DataFrame, evidence: DataFrame, now: str | None = None, busy: DataFrame | None = None, routes: list[str] | None = None) -> DataFrame:
    """Distinct coordinates with a purl and a route, without fresh evidence and without an active job.

    Evidence with an expires_at before now isn't fresh. routes: ecosystems that have one; busy: ecosystem, namespace, name.
    """
    key = ["ecosystem", "namespace", "name"]
    own = components.filter("purl IS NOT NULL")
    own = own if routes is None else own.filter(F.col("ecosystem").isin(routes))
    fresh = evidence if now is None else evidence.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now).cast("timestamp")))
    out = own.select(*key).distinct().join(fresh.select(*key).distinct(), key, "left_anti")
    return out if busy is None else out.join(busy.select(*key).distinct(), key, "left_anti")


def package_mapping(components: DataFrame, snapshots: DataFrame, depends: DataFrame | None = None) -> DataFrame:
    """(repository_id, relation, purl): roots provide; what a resolved DEPENDS_ON leads to is depended on; each once.

    depends: snapshot_id, to_element, of resolved relationships; without it all that isn't a root is depended on.
    """
    c = components.filter("purl IS NOT NULL").join(snapshots.select(F.col("id").alias("snapshot_id"), "repository_id"), "snapshot_id")
    if depends is None:
        return c.select("repository_id", F.when(F.col("is_root"), "provides").otherwise("depends_on").alias("relation"), "purl").distinct()
    told = c.join(depends.select("snapshot_id", F.col("to_element").alias("element_id")).distinct(), ["snapshot_id", "element_id"], "left_semi")
    return c.filter("is_root").select("repository_id", F.lit("provides").alias("relation"), "purl").unionByName(told.select("repository_id", F.lit("depends_on").alias("relation"), "purl")).distinct()


def replace_mapping(stored: DataFrame, computed: DataFrame, source: str = "automatic") -> DataFrame:
    """The stored mapping with the rows of one source replaced by computed ones for the repositories that were computed."""
    gone = computed.select("repository_id").distinct().withColumn("source", F.lit(source))
    return stored.join(gone, ["repository_id", "source"], "left_anti").unionByName(computed.withColumn("source", F.lit(source)).select(*stored.columns))


def approximate_locations(req: DataFrame, exact: DataFrame, mapping: DataFrame, uploads: DataFrame, definitions: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, provider, path, line, no): definitions in the repositories that provide a symbol's package.

    Only requests without exact locations (query_id) go on. req: query_id, repository_id, package, symbol_key; mapping:
    repository_id, relation, package, source; manual providers beat automatic ones, then the smallest id. uploads: repository_id,
    upload_id (the current one); definitions: upload_id, symbol_key (a symbol without its version), path, line. Places go by path and
    line, then by provider: a request that asks for several packages may find one place with several of them.
    """
    open_ = req.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    needs = mapping.filter("relation = 'depends_on'").select("repository_id", "package").distinct()
    open_ = open_.join(needs, ["repository_id", "package"], "left_semi")
    first = F.min(F.struct(F.when(F.col("source") == "manual", 0).otherwise(1).alias("rank"), F.col("repository_id").alias("provider"))).alias("p")
    gives = mapping.filter("relation = 'provides'").groupBy("package").agg(first).select("package", "p.provider")
    hit = open_.join(gives, "package").join(uploads.select(F.col("repository_id").alias("provider"), "upload_id"), "provider").join(definitions, ["upload_id", "symbol_key"])
    w = Window.partitionBy("query_id").orderBy("path", "line", "provider")
    return hit.select("query_id", "provider", "path", "line").distinct().withColumn("no", F.row_number().over(w)).filter(F.col("no") <= limit)


def providers(mapping: DataFrame) -> DataFrame:
    """For each consumer the repositories that provide its packages: one provider a package, that with the least id."""
    d = mapping.filter("relation = 'depends_on'").select(F.col("repository_id").alias("consumer"), "purl")
    p = mapping.filter("relation = 'provides'").groupBy("purl").agg(F.min("repository_id").alias("provider"))
    return d.join(p, "purl").filter("consumer <> provider").groupBy("consumer", "provider").agg(F.count("*").alias("packages"))


def satisfies(methods: DataFrame, embeds: DataFrame | None = None) -> DataFrame:
    """(type, interface) of one package where the type has every method of the interface, embedded ones included.

    methods: package, owner, kind (interface or class), name, signature. embeds: package, interface, embedded; an interface embeds those
    of its own package only. Candidates meet by the
    interface's rarest method only, so that common names don't pair everything; then what they share is counted.
    """
    own = methods.select("package", "owner", "kind", F.concat_ws("#", "name", "signature").alias("m")).distinct()
    asks = own.filter("kind = 'interface'").select("package", F.col("owner").alias("interface"), "m")
    if embeds is not None:
        have = durable(asks)
        while True:
            more = embeds.join(have.withColumnRenamed("interface", "embedded"), ["package", "embedded"]).select("package", "interface", "m").join(have, ["package", "interface", "m"], "left_anti").distinct()
            more = durable(more)
            if more.isEmpty():
                break
            have = durable(have.unionByName(more))
        asks = have
    has = own.filter("kind = 'class'").select("package", F.col("owner").alias("type"), "m")
    n = has.groupBy("package", "m").agg(F.count("*").alias("holders"))
    need = asks.groupBy("package", "interface").agg(F.count("*").alias("need"))
    rare = asks.join(n, ["package", "m"], "left").groupBy("package", "interface").agg(F.min(F.struct(F.coalesce("holders", F.lit(0)).alias("holders"), "m")).alias("r")).filter("r.holders > 0").select("package", "interface", F.col("r.m").alias("m"))
    near = rare.join(has, ["package", "m"]).select("package", "interface", "type")
    got = near.join(asks, ["package", "interface"]).join(has, ["package", "type", "m"]).groupBy("package", "interface", "type").agg(F.count("*").alias("got"))
    return got.join(need, ["package", "interface"]).filter("got = need").select("type", "interface")


def resolve(references: DataFrame, declarations: DataFrame, imports: DataFrame) -> DataFrame:
    """(reference_id, tier, target) of names: the first tier in which a reference has exactly one candidate decides.

    references: reference_id, path, module, name, symbol; declarations: occurrence, path, module, name, symbol; imports: path,
    module, name (null for everything of the module), alias (null for the name itself). 1 symbol, 2 imported by name or
    alias, 3 imported with its module, 4 same file, 5 same module.

    Candidates of a key are one where the smallest and the largest are the same, so declarations fold to these two before they
    meet the references: a key gives one row, however many declarations share it.
    """
    ends = lambda rows, *key: rows.groupBy(*key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    d = declarations.select(F.col("occurrence").alias("lo"), F.col("occurrence").alias("hi"), "path", "module", "name", "symbol")
    of_module = ends(d, "module", "name")
    asked = references.select("path", "name").distinct()
    named = imports.filter("name IS NOT NULL").select("path", F.coalesce("alias", "name").alias("name"), F.col("module").alias("m"), F.col("name").alias("n")).distinct()
    whole = imports.filter("name IS NULL").select("path", "module").distinct()
    tiers = (
        (["symbol"], ends(d, "symbol")),
        (["path", "name"], ends(asked.join(named, ["path", "name"]).join(of_module.toDF("m", "n", "lo", "hi"), ["m", "n"]), "path", "name")),
        (["path", "name"], ends(asked.join(whole, "path").join(of_module, ["module", "name"]), "path", "name")),
        (["path", "name"], ends(d, "path", "name")),
        (["module", "name"], of_module),
    )
    rows = references.select("reference_id", "path", "module", "name", "symbol")
    for no, (key, found) in enumerate(tiers, 1):
        rows = rows.join(found.withColumnsRenamed({"lo": f"lo{no}", "hi": f"hi{no}"}), key, "left")
    by = rows.groupBy("reference_id").agg(*[f(f"{c}{no}").alias(f"{c}{no}") for no in range(1, 6) for f, c in ((F.min, "lo"), (F.max, "hi"))])
    best = F.coalesce(*[F.when(F.col(f"lo{no}") == F.col(f"hi{no}"), F.struct(F.lit(no).alias("tier"), F.col(f"lo{no}").alias("target"))) for no in range(1, 6)])
    return by.select("reference_id", best.alias("b")).filter("b IS NOT NULL").select("reference_id", "b.tier", "b.target")


def resolved_edges(references: DataFrame, resolved: DataFrame) -> DataFrame:
    """(source, target, kind, confidence): an edge for each resolved reference, once; imports are certain, the rest 0.9."""
    e = references.select("reference_id", "source", "kind").join(resolved.select("reference_id", "target"), "reference_id")
    return e.select("source", "target", "kind", F.when(F.col("kind") == "imports", 1.0).otherwise(0.9).alias("confidence")).distinct()


def symbol_context(edges: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """Incoming and outgoing neighbours of each root by relation, `limit` of each, in edge order."""
    kinds = ["calls", "references", "extends", "implements"]
    out = edges.filter(F.col("kind").isin(kinds)).select(F.explode(F.array(F.struct(F.lit("outgoing").alias("direction"), F.col("source").alias("root"), F.col("target").alias("node")), F.struct(F.lit("incoming").alias("direction"), F.col("target").alias("root"), F.col("source").alias("node")))).alias("x"), "kind", "occurrence").select("x.*", "kind", "occurrence")
    w = Window.partitionBy("query_id", "direction", "kind").orderBy("node", "occurrence")
    return roots.join(out, "root").withColumn("no", F.row_number().over(w)).filter(F.col("no") <= limit).select("query_id", "direction", "kind", "node", "no")
