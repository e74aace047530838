"""Supply-chain portfolio: snapshots, component roll-ups, shared dependencies, comparison, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import family


def coordinate(ecosystem: str = "ecosystem", namespace: str = "namespace", name: str = "name", version: str | None = "version") -> Column:
    """Key of a coordinate: its parts, missing ones as empty, joined by a character that none of them has."""
    return F.concat_ws("\x01", *[F.coalesce(c, F.lit("")) for c in (ecosystem, namespace, name, *([version] if version else []))])


def authorised(repositories: DataFrame, installations: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Enabled repositories that aren't archived, of active installations, among the wanted ids."""
    out = repositories.filter("enabled AND NOT archived")
    if installations is not None:
        out = out.join(installations.select(F.col("id").alias("installation_id")), "installation_id", "left_semi")
    return out if wanted is None else out.join(wanted.select("id"), "id", "left_semi")


def latest_snapshots(snapshots: DataFrame, repositories: DataFrame) -> DataFrame:
    """The last snapshot of each stream of an authorised repository."""
    own = snapshots.join(repositories.select(F.col("id").alias("repository_id")), "repository_id", "left_semi")
    last = F.max(F.struct("id", "collected_at", "outcome")).alias("s")
    return own.groupBy("repository_id", "stream_key").agg(last).select("repository_id", "stream_key", F.col("s.id").alias("snapshot_id"), "s.collected_at", "s.outcome")


def overview(repositories: DataFrame, latest: DataFrame, now: str, interval_days: int, opted_out: DataFrame | None = None) -> DataFrame:
    """One row of portfolio counts; a repository's state is that of its newest stream.

    Stale is older than twice the interval. opted_out: repository_id. latest may have components and edges, which are summed.
    """
    sums = [c for c in ("components", "edges") if c in latest.columns]
    by = latest.groupBy("repository_id").agg(F.max("collected_at").alias("at"), F.max_by("outcome", F.struct("collected_at", "snapshot_id")).alias("outcome"), *[F.sum(c).alias(c) for c in sums])
    all_ = repositories.join(by.withColumnRenamed("repository_id", "id"), "id", "left")
    out = [] if opted_out is None else [F.count("_out").alias("opted_out")]
    if opted_out is not None:
        all_ = all_.join(opted_out.select(F.col("repository_id").alias("id"), F.lit(True).alias("_out")).distinct(), "id", "left")
    stale = F.col("at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {2 * interval_days} DAYS")
    return all_.agg(
        F.count("*").alias("repositories"),
        F.count("at").alias("with_inventory"),
        F.count_if(stale).alias("stale"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("at").isNull()).alias("never"),
        F.min("at").alias("oldest"),
        F.max("at").alias("newest"),
        *out,
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
    )


def coordinates_by_ecosystem(components: DataFrame) -> DataFrame:
    """Occurrences fold to coordinates first, then to ecosystems."""
    by = components.groupBy("ecosystem", "namespace", "name", "version").agg(F.count("*").alias("n"), F.count_if(F.col("purl").isNull()).alias("bare"))
    return by.groupBy("ecosystem").agg(
        F.sum("n").alias("occurrences"), F.count("*").alias("coordinates"), F.sum("bare").alias("without_purl"), F.sum(F.when(F.col("version").isNull(), F.col("n")).otherwise(0)).alias("without_version")
    )


def component_page(components: DataFrame, search: str | None = None, ecosystem: str | None = None, status: str | None = None, licence: str | None = None, after: tuple | None = None, limit: int | None = None) -> DataFrame:
    """One row per coordinate: counts, distinct statuses and raw licences, and a label: one status, mixed or unassessed.

    Searches are literal, in name, namespace and package URL. after is the key of the last row of the page before:
    (ecosystem, namespace, name, version), empty for none.
    """
    key = ["ecosystem", "namespace", "name", "version"]
    c = components
    if ecosystem:
        c = c.filter(F.col("ecosystem") == ecosystem)
    if search:
        c = c.filter(F.lower("name").contains(search.lower()) | F.lower(F.coalesce("namespace", F.lit(""))).contains(search.lower()) | F.lower(F.coalesce("purl", F.lit(""))).contains(search.lower()))
    if status:
        c = c.filter(F.coalesce("status", F.lit("unassessed")) == status)
    if licence:
        c = c.filter(F.col("license_raw") == licence)
    by = c.groupBy(*key).agg(
        F.count("*").alias("occurrences"), F.countDistinct("snapshot_id").alias("snapshots"), F.sort_array(F.collect_set("status")).alias("statuses"), F.sort_array(F.collect_set("license_raw")).alias("licenses"), F.max("license_raw").alias("expression"), F.count_if(F.col("status").isNull()).alias("open")
    )
    label = F.when(F.size("statuses") == 0, "unassessed").when((F.size("statuses") == 1) & (F.col("open") == 0), F.element_at("statuses", 1)).otherwise("mixed")
    out = by.select(*key, "occurrences", "snapshots", "statuses", "licenses", "expression", label.alias("label"))
    if after is None and limit is None:
        return out
    order = [F.coalesce(F.col(k), F.lit("")) for k in key]
    if after is not None:
        out = out.filter(F.struct(*order) > F.struct(*map(F.lit, after)))
    return out.orderBy(*order).limit(limit) if limit else out


def shared_packages(components: DataFrame, latest: DataFrame, least: int, top: int) -> DataFrame:
    """Packages (no version) that at least so many repositories use, most shared first, with how many match in all.

    versions, statuses and expressions are sorted sets, gathered for the top packages only; risky: one of them is in conflict
    or unlicensed.
    """
    key = ["ecosystem", "namespace", "name"]
    used = components.join(latest.select("snapshot_id", "repository_id"), "snapshot_id")
    by = used.select(*key, "repository_id").distinct().groupBy(*key).agg(F.count("*").alias("repositories")).filter(F.col("repositories") >= least)
    matching = by.agg(F.count("*").alias("matching"))
    best = by.orderBy(F.desc("repositories"), *key).limit(top).crossJoin(F.broadcast(matching))
    own = used.join(F.broadcast(best), key).groupBy(*key, "repositories", "matching").agg(
        F.count("*").alias("occurrences"), F.coalesce(F.bool_or(F.col("status").isin("conflict", "unlicensed")), F.lit(False)).alias("risky"), F.sort_array(F.collect_set("version")).alias("versions"),
        F.sort_array(F.collect_set("status")).alias("statuses"), F.sort_array(F.collect_set("license_raw")).alias("expressions"), F.countDistinct("snapshot_id").alias("snapshots"),
    )
    return own


def bipartite(components: DataFrame, latest: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph of repositories and the given packages, a bounded top list as shared_packages gives it.

    nodes: (node, kind, risky, partial): partial where the list leaves out matching packages. edges: (package, repository_id), once.
    """
    p = packages.withColumn("package", coordinate(version=None))
    used = components.join(F.broadcast(p.select("ecosystem", "namespace", "name", "package")), ["ecosystem", "namespace", "name"])
    edges = used.join(latest.select("snapshot_id", "repository_id"), "snapshot_id").select("package", "repository_id").distinct()
    shown = packages.agg(F.count("*").alias("shown"))
    left_out = F.col("matching") > F.col("shown")
    nodes = p.crossJoin(F.broadcast(shown)).select(F.col("package").alias("node"), F.lit("package").alias("kind"), "risky", left_out.alias("partial"))
    repos = edges.select(F.col("repository_id").cast("string").alias("node")).distinct().select("node", F.lit("repository").alias("kind"), F.lit(False).alias("risky"), F.lit(False).alias("partial"))
    return nodes.unionByName(repos), edges


def facets(components: DataFrame, tops: dict[str, int]) -> DataFrame:
    """(facet, value, n): the most frequent values of each column in one pass over the rows."""
    names = list(tops)
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.coalesce(F.col(f), F.lit("unassessed" if f == "status" else "none")).alias("value")) for f in names])
    by = components.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
    limit = F.coalesce(*[F.when(F.col("facet") == f, F.lit(n)) for f, n in tops.items()])
    return by.withColumn("r", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).filter(F.col("r") <= limit).drop("r")


def occurrences_of(components: DataFrame, latest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Repositories whose latest snapshots hold exact coordinates; wanted: ecosystem, namespace, name, version."""
    w = wanted.select(coordinate().alias("key")).distinct()
    return components.withColumn("key", coordinate()).join(w, "key", "left_semi").join(latest.select("snapshot_id", "repository_id"), "snapshot_id").select("repository_id", "snapshot_id", "element_id", "is_root", "status")


def compare(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Coordinates added and removed and licences changed, per group of columns `by`."""
    cols = [*by, "key"]
    fold = lambda d, n: d.withColumn("key", coordinate()).groupBy(*cols).agg(F.min("license_raw").alias(n), F.lit(True).alias(f"in_{n}"))
    both = fold(before, "old").join(fold(after, "new"), cols, "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "license_changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").groupBy(*by, "change").agg(F.count("*").alias("n"))


def compare_snapshots(components: DataFrame, edges: DataFrame, snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, change, n) between two snapshots each. pairs: pair_id, before, after.

    added and removed coordinates, license_changed on the same element and coordinate, edge_added and edge_removed, and one row
    for each of the snapshots' own columns that differs (changed_COLUMN). edges: snapshot_id, from_element, relationship, to_element.
    """
    # both snapshots of a pair in one join: a row comes once for each pair and end that its snapshot has
    ends = pairs.select("pair_id", F.explode(F.array(*[F.struct(F.col(e).alias("snapshot_id"), F.lit(e == "before").alias("old")) for e in ("before", "after")])).alias("x")).select("pair_id", "x.*")
    either = [F.bool_or("old").alias("was"), F.bool_or(~F.col("old")).alias("is")]

    def differ(rows: DataFrame, key: list[str], plus: str, minus: str) -> DataFrame:
        both = rows.select("snapshot_id", *key).join(ends, "snapshot_id").groupBy("pair_id", *key).agg(*either).filter("NOT (was AND is)")
        return both.select("pair_id", F.when(F.col("was"), minus).otherwise(plus).alias("change"), F.lit(1).cast("long").alias("n"))

    c = components.withColumn("key", coordinate())
    # elements of both ends whose licences differ: all pairs of them less those of one licence
    n = [F.count_if("old").alias("b"), F.count_if(~F.col("old")).alias("a")]
    by = c.select("snapshot_id", "element_id", "key", "license_raw").join(ends, "snapshot_id").groupBy("pair_id", "element_id", "key", "license_raw").agg(*n)
    apart = by.filter("element_id IS NOT NULL").groupBy("pair_id", "element_id", "key").agg((F.sum("b") * F.sum("a") - F.sum(F.col("b") * F.col("a"))).alias("n"))
    relicensed = apart.filter("n > 0").select("pair_id", F.lit("license_changed").alias("change"), "n")
    out = differ(c, ["key"], "added", "removed").unionByName(relicensed).unionByName(differ(edges, ["from_element", "relationship", "to_element"], "edge_added", "edge_removed"))
    own = [x for x in snapshots.columns if x not in ("id", "collected_at", "repository_id")]
    meta = pairs
    for end in ("before", "after"):
        meta = meta.join(snapshots.select(F.col("id").alias(end), *[F.col(x).alias(f"{x}_{end}") for x in own]), end)
    for x in own:
        out = out.unionByName(meta.filter(~F.col(f"{x}_before").eqNullSafe(F.col(f"{x}_after"))).select("pair_id", F.lit(f"changed_{x}").alias("change"), F.lit(1).cast("long").alias("n")))
    return out.groupBy("pair_id", "change").agg(F.sum("n").alias("n"))


def inventory_status(repositories: DataFrame, latest: DataFrame, now: str, stale_days: int, components: DataFrame | None = None) -> DataFrame:
    """never, failed, stale or current, and the age in seconds; with components also how many there are and have a licence text."""
    by = latest.groupBy(F.col("repository_id").alias("id")).agg(F.max("collected_at").alias("at"), F.max_by("outcome", F.struct("collected_at", "snapshot_id")).alias("outcome"))
    t = F.lit(now).cast("timestamp")
    age = F.unix_timestamp(t) - F.unix_timestamp("at")
    state = F.when(F.col("at").isNull(), "never").when(F.col("outcome") == "failed", "failed").when(age > stale_days * 86400, "stale").otherwise("current")
    out = repositories.select("id").join(by, "id", "left").select("id", state.alias("state"), age.alias("age"))
    if components is None:
        return out
    n = components.join(latest.select("snapshot_id", F.col("repository_id").alias("id")), "snapshot_id").groupBy("id").agg(F.count("*").alias("components"), F.count_if(F.trim("license_raw") != "").alias("licensed"))
    return out.join(n, "id", "left").na.fill(0, ["components", "licensed"])


def history(snapshots: DataFrame, newest: int) -> DataFrame:
    w = Window.partitionBy("repository_id").orderBy(F.desc("id"))
    return snapshots.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= newest).select("repository_id", "id", "outcome", "no")


def retention(snapshots: DataFrame, keep: int, used: list[DataFrame]) -> DataFrame:
    """Snapshots to drop: beyond the newest `keep` of a stream and named by none of `used` (columns: id)."""
    w = Window.partitionBy("repository_id", "stream_key").orderBy(F.desc("id"))
    out = snapshots.withColumn("no", F.row_number().over(w)).filter(F.col("no") > keep)
    for u in used:
        out = out.join(u.select("id"), "id", "left_anti")
    return out.select("id", "repository_id", "stream_key")


def due_streams(streams: DataFrame, repositories: DataFrame, cutoff: str, busy: DataFrame | None = None) -> DataFrame:
    """Streams to collect: of authorised repositories, not opted out, never attempted or last before the cutoff, without an active job.

    streams: repository_id, stream_key, last_attempt, opt_out. busy: repository_id, stream_key. place: never attempted first,
    then by attempt.
    """
    ok = authorised(repositories).select(F.col("id").alias("repository_id"))
    due = streams.filter(~F.coalesce("opt_out", F.lit(False))).join(ok, "repository_id", "left_semi").filter(F.col("last_attempt").isNull() | (F.col("last_attempt") < F.lit(cutoff).cast("timestamp")))
    return due if busy is None else due.join(busy.select("repository_id", "stream_key"), ["repository_id", "stream_key"], "left_anti")


def share_links(rows: DataFrame, key: str, ids: str, total: int) -> DataFrame:
    """Where a page's links exceed the total each item keeps an equal share of them, lowest ids first."""
    all_ = rows.agg(F.sum(F.size(ids)).alias("_links"), F.count("*").alias("_items"))
    share = F.when(F.col("_links") > total, F.greatest(F.floor(F.lit(total) / F.col("_items")), F.lit(1))).otherwise(F.lit(2**31 - 1)).cast("int")
    return rows.crossJoin(F.broadcast(all_)).select(key, F.slice(F.sort_array(ids), F.lit(1), share).alias(ids))


def license_mix(components: DataFrame, latest: DataFrame, top: int = 5, column: str = "license_raw") -> DataFrame:
    """Per repository and family: components, and the expressions behind them, most frequent first, `top` of them at most.

    licensed is the number of the repository's components that have any licence text.
    """
    used = components.join(latest.select("snapshot_id", "repository_id"), "snapshot_id")
    by = used.groupBy("repository_id", family(F.col(column)).alias("family"), F.col(column).alias("expression")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("repository_id", "family").orderBy(F.desc("n"), F.coalesce("expression", F.lit("")))
    ranked = by.withColumn("r", F.row_number().over(w))
    parts = F.filter(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "expression", "n")))), lambda x: x.isNotNull())
    return ranked.groupBy("repository_id", "family").agg(F.sum("n").alias("n"), F.sum(F.when(F.trim("expression") != "", F.col("n")).otherwise(0)).alias("licensed"), F.transform(parts, lambda x: F.struct(x["expression"].alias("expression"), x["n"].alias("n"))).alias("expressions"))


def assessed_share(components: DataFrame, latest: DataFrame) -> DataFrame:
    used = components.join(latest.select("snapshot_id", "repository_id"), "snapshot_id")
    by = used.groupBy("repository_id").agg(F.count("status").alias("assessed"), F.count("*").alias("all"))
    return by.select("repository_id", "assessed", "all", F.when(F.col("all") > 0, F.col("assessed") / F.col("all")).alias("share"))


def facet_sums(facets_by: DataFrame) -> DataFrame:
    """(facet, value, n, share) over a scope from the facets of its repositories: facet, value, n.

    share is set for the facet status: assessed over all components, zero for an empty scope.
    """
    by = facets_by.groupBy("facet", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("facet")
    assessed = F.sum(F.when(F.col("value") != "unassessed", F.col("n")).otherwise(0)).over(w) / F.sum("n").over(w)
    return by.withColumn("share", F.when(F.col("facet") == "status", assessed))


def facets_by_repository(components: DataFrame, latest: DataFrame, columns: list[str]) -> DataFrame:
    """(repository_id, facet, value, n) over the latest snapshots."""
    used = components.join(latest.select("snapshot_id", "repository_id"), "snapshot_id")
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.coalesce(F.col(f), F.lit("unassessed" if f == "status" else "none")).alias("value")) for f in columns])
    return used.select("repository_id", F.explode(pairs).alias("x")).groupBy("repository_id", "x.facet", "x.value").agg(F.count("*").alias("n"))


def component_list(components: DataFrame, scopes: DataFrame, search: str | None = None, first: int = 0, size: int = 100) -> DataFrame:
    """A page of each snapshot's components in ordinal order, with dependency scope and assessment.

    scopes: snapshot_id, element_id, scope; what isn't in it is unknown. search is literal, in name and package URL.
    """
    c = components
    if search:
        c = c.filter(F.lower("name").contains(search.lower()) | F.lower(F.coalesce("purl", F.lit(""))).contains(search.lower()))
    w = Window.partitionBy("snapshot_id").orderBy("ordinal", "element_id")
    c = c.withColumn("no", F.row_number().over(w)).filter((F.col("no") > first) & (F.col("no") <= first + size))
    return c.join(scopes, ["snapshot_id", "element_id"], "left").select("snapshot_id", "element_id", "no", "name", "version", "is_root", F.coalesce("scope", F.lit("unknown")).alias("scope"), F.coalesce("status", F.lit("unassessed")).alias("status"))


def component_detail(components: DataFrame, scopes: DataFrame, relationships: DataFrame, evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per wanted component (snapshot_id, element_id): its facts, scope, relationships at either end and evidence.

    evidence: ecosystem, namespace, name, source, license_raw, id; relationships: snapshot_id, from_element, relationship, to_element.
    evidence comes newest first, relationships by kind and other end. Wanted elements that don't exist have no row.
    """
    key = ["snapshot_id", "element_id"]
    c = components.join(wanted.select(*key).distinct(), key, "left_semi")
    ends = [relationships.select("snapshot_id", F.col(f"{a}_element").alias("element_id"), F.struct("relationship", F.lit(a).alias("end"), F.col(f"{b}_element").alias("other")).alias("r")) for a, b in (("from", "to"), ("to", "from"))]
    rel = ends[0].unionByName(ends[1]).join(c.select(*key), key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_set("r")).alias("relationships"))
    coord = ["ecosystem", "namespace", "name"]
    ev = evidence.join(c.select(*coord).distinct(), coord, "left_semi").groupBy(*coord).agg(F.reverse(F.array_sort(F.collect_set(F.struct("id", "source", "license_raw")))).alias("evidence"))
    return c.join(scopes, key, "left").join(rel, key, "left").join(ev, coord, "left").select(*key, *coord, "version", "purl", "license_raw", F.coalesce("scope", F.lit("unknown")).alias("scope"), F.coalesce("status", F.lit("unassessed")).alias("status"), "relationships", "evidence")


def history_rules(collections: DataFrame, jobs: DataFrame, deliveries: DataFrame, now: str, keep: int, jobs_kept: int, job_days: int, delivery_days: int = 30) -> DataFrame:
    """(what, id) of history to drop: collections beyond the newest of their stream, jobs too old, finished jobs beyond the newest of
    their repository, deliveries past their days. All have id; collections repository_id, stream_key; jobs repository_id,
    finished_at (null while active), deliveries received_at."""
    before = lambda c, days: F.col(c) < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    no = lambda rows, key: rows.withColumn("_no", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("id"))))
    old = no(collections, ["repository_id", "stream_key"]).filter(F.col("_no") > keep).select(F.lit("collection").alias("what"), "id")
    done = no(jobs.filter("finished_at IS NOT NULL"), ["repository_id"])
    return old.unionByName(done.filter((F.col("_no") > jobs_kept) | before("finished_at", job_days)).select(F.lit("job").alias("what"), "id")).unionByName(deliveries.filter(before("received_at", delivery_days)).select(F.lit("delivery").alias("what"), "id"))


# The columns of an exported inventory, in order.
CSV_COLUMNS = ("repository", "snapshot_id", "stream", "producer", "collected_at", "document_sha256", "element_id", "name", "version", "purl", "ecosystem", "is_root", "license_declared_raw", "license_concluded_raw", "assessment_status", "assessed_expression")


def export_rows(components: DataFrame, snapshots: DataFrame, repositories: DataFrame) -> DataFrame:
    """The inventory as text cells of CSV_COLUMNS, ready for write.csv(header=True).

    components: snapshot_id, element_id and component columns; snapshots: id, repository_id, stream_key, collected_at, and
    producer and document_sha256 if there are such. Times are RFC 3339; no cell begins like a formula; missing ones are empty.
    """
    s = snapshots.select(F.col("id").alias("snapshot_id"), "repository_id", F.col("stream_key").alias("stream"), "collected_at", *[c for c in ("producer", "document_sha256") if c in snapshots.columns])
    r = repositories.select(F.col("id").alias("repository_id"), F.col("name").alias("repository"))
    rows = components.join(s, "snapshot_id").join(r, "repository_id")
    rows = rows.withColumn("collected_at", F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    names = {"license_declared_raw": "license_raw", "assessment_status": "status", "assessed_expression": "expression"}
    own = lambda c: c if c in rows.columns else names.get(c, c)
    return rows.select(*[(csv_cell(own(c)) if own(c) in rows.columns else F.lit("")).alias(c) for c in CSV_COLUMNS])


def csv_cell(column: str) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r|%]"), F.concat(F.lit("'"), text)).otherwise(text)
