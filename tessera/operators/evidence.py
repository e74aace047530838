"""Registry evidence, histories and pages: documents to raw licences, newest rows, keyset pages, ignore rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import durable


def npm_license(body: Column, version: Column) -> Column:
    """struct(raw, kind) of a package document; rejected where its version is another one."""
    license_ = F.get_json_object(body, "$.license")
    old = F.get_json_object(body, "$.license.type")
    raw = F.coalesce(old, license_)
    kind = F.when(~F.get_json_object(body, "$.version").eqNullSafe(version), "rejected").when(old.isNotNull(), "legacy_object").when(F.upper(raw).startswith("SEE LICENSE IN "), "file").when(raw.isNull(), "missing").otherwise("expression")
    return F.struct(raw.alias("raw"), kind.alias("kind"))


def nuspec_license(body: Column, id_: Column, version: Column) -> Column:
    """struct(raw, kind) of a package manifest in XML; id and version must match in any case."""
    one = lambda p: F.nullif(F.xpath_string(body, F.lit(p)), F.lit(""))
    expression, file_, url = one("//license[@type='expression']"), one("//license[@type='file']"), one("//licenseUrl")
    fits = (F.lower(one("//metadata/id")) == F.lower(id_)) & (F.lower(one("//metadata/version")) == F.lower(version))
    kind = F.when(~F.coalesce(fits, F.lit(False)), "rejected").when(expression.isNotNull(), "expression").when(file_.isNotNull(), "file").when(url.isNotNull(), "url").otherwise("missing")
    return F.struct(F.coalesce(expression, file_, url).alias("raw"), kind.alias("kind"))


def outcome(status: Column, fetched_at: Column, ttl_days: dict[str, int], malformed: Column | None = None) -> Column:
    """struct(outcome, expires_at) of a fetch by HTTP status; only negative outcomes expire.

    malformed says that a body came but couldn't be read.
    """
    bad = F.lit(False) if malformed is None else F.coalesce(malformed, F.lit(False))
    what = F.when((status == 200) & bad, "malformed").when(status == 200, "resolved").when(status.isin(404, 410), "not_found").when(status == 413, "too_large").when(status.isin(401, 403), "rejected").otherwise("unavailable")
    days = F.coalesce(*[F.when(what == k, F.lit(v)) for k, v in ttl_days.items()])
    return F.struct(what.alias("outcome"), F.when(days.isNotNull(), fetched_at + F.make_interval(days=days)).alias("expires_at"))


def evidence_history(rows: DataFrame, key: list[str], first: int = 0, size: int = 50) -> DataFrame:
    """A page of each coordinate's evidence, newest first, with its number."""
    w = Window.partitionBy(*key).orderBy(F.desc("id"))
    return rows.withColumn("no", F.row_number().over(w)).filter((F.col("no") > first) & (F.col("no") <= first + size))


def parse_pom(body: Column) -> Column:
    """struct(key, parent, licenses array, properties map) of a project file in XML; key and parent are group:artifact:version.

    A project without its own group or version has its parent's. Coordinates may hold ${properties}.
    """
    one = lambda p: F.nullif(F.trim(F.xpath_string(body, F.lit(f"/project/{p}"))), F.lit(""))
    many = lambda p: F.coalesce(F.xpath(body, F.lit(f"/project/{p}/text()")), F.array().cast("array<string>"))
    group, version = F.coalesce(one("groupId"), one("parent/groupId")), F.coalesce(one("version"), one("parent/version"))
    parent = F.when(one("parent/artifactId").isNotNull(), F.concat_ws(":", one("parent/groupId"), one("parent/artifactId"), one("parent/version")))
    names = F.regexp_extract_all(F.regexp_extract(body, "(?s)<properties>(.*?)</properties>", 1), F.lit("<([A-Za-z0-9_.-]+)>[^<]*</"), F.lit(1))
    values = F.regexp_extract_all(F.regexp_extract(body, "(?s)<properties>(.*?)</properties>", 1), F.lit("<[A-Za-z0-9_.-]+>([^<]*)</"), F.lit(1))
    return F.struct(F.concat_ws(":", group, one("artifactId"), version).alias("key"), parent.alias("parent"), F.transform(many("licenses/license/name"), F.trim).alias("licenses"), F.map_from_arrays(names, values).alias("properties"))


def expand(text: Column, properties: Column, passes: int = 4) -> Column:
    """text with ${name} replaced by properties, which may name others, in so many passes."""
    for _ in range(passes):
        text = F.aggregate(F.map_entries(properties), text, lambda t, e: F.replace(t, F.concat(F.lit("${"), e["key"], F.lit("}")), e["value"]))
    return text


def maven_licenses(poms: DataFrame, requests: DataFrame, names: dict[str, str], depth: int = 8) -> DataFrame:
    """(query_id, outcome, raw, steps): licences along the parent chain. poms: key, parent, licenses, properties. requests: query_id, key.

    The first project with licences decides: one whose name is known (names: licence name → identifier) gives that, another
    name stays itself, several are a list that no expression parser takes. Properties of children win. Without
    licences the outcome says why: no_license, cyclic, too_deep, parent_unresolved (a property is missing) or parent_missing.
    One join for each step of all chains.
    """
    known = durable(poms.select("key", "parent", "licenses", "properties"))
    state = requests.select("query_id", "key", F.array().cast("array<string>").alias("chain"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("props"))
    done = None
    for step in range(depth + 2):
        at = state.join(known, "key", "left")
        mine = F.coalesce("properties", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        props = F.map_concat("props", F.map_filter(mine, lambda k, v: ~F.map_contains_key("props", k)))
        at = at.withColumn("props", props).withColumn("next", expand(F.col("parent"), F.col("props")))
        why = (
            F.when(F.array_contains("chain", F.col("key")), "cyclic").when(F.col("licenses").isNull(), "parent_missing" if step else "not_found").when(F.size("licenses") > 0, "resolved")
            .when(F.col("parent").isNull(), "no_license").when(F.lit(step >= depth), "too_deep").when(F.contains("next", F.lit("${")), "parent_unresolved")
        )
        at = durable(at.withColumn("why", why))
        end = at.filter("why IS NOT NULL").select("query_id", "why", "licenses", F.lit(step).alias("steps"))
        done = end if done is None else done.unionByName(end)
        state = at.filter("why IS NULL").select("query_id", F.col("next").alias("key"), F.concat("chain", F.array("key")).alias("chain"), "props")
        if state.isEmpty():
            break
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in (kv[0].lower(), kv[1])])
    one = F.coalesce(F.try_element_at(table, F.lower(F.element_at("licenses", 1))), F.element_at("licenses", 1))
    raw = F.when(F.col("why") == "resolved", F.when(F.size("licenses") == 1, one).otherwise(F.array_join("licenses", "; ")))
    return done.select("query_id", F.col("why").alias("outcome"), raw.alias("raw"), "steps")


def with_human(rows: DataFrame, by: list[str]) -> DataFrame:
    """The newest human statement wins; whether the machine's newest one disagrees is kept. rows: by, id, human, value."""
    own = F.max_by(F.when(F.col("human"), F.col("value")), F.when(F.col("human"), F.col("id")))
    machine = F.max_by(F.when(~F.col("human"), F.col("value")), F.when(~F.col("human"), F.col("id")))
    agg = rows.groupBy(*by).agg(own.alias("human_value"), machine.alias("machine_value"))
    return agg.select(*by, F.coalesce("human_value", "machine_value").alias("value"), (F.col("human_value") != F.col("machine_value")).alias("disagrees"))


def page(rows: DataFrame, order: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The rows after a key, in order: a keyset page."""
    if after is not None:
        later = F.lit(False)
        for i, c in enumerate(order):
            here = F.col(c) > F.lit(after[i])
            for j in range(i):
                here = here & (F.col(order[j]) == F.lit(after[j]))
            later = later | here
        rows = rows.filter(later)
    return rows.orderBy(*order).limit(limit)


def bound_pages(req: DataFrame, matched: DataFrame, order: list[str], limit: int) -> DataFrame:
    """(query_id, status, no, order columns, next_cursor): pages of several questions, each cursor bound to what was asked.

    req: query_id, scope and filter (what makes the question, canonical texts), cursor (null for the first page). matched: query_id and
    the order columns, which are unique within a question: all rows that fit. A cursor is the base64 form of a fingerprint of scope, filter,
    order and limit, and of the last row shown. One that can't be read gives a row with the status invalid, one of
    another fingerprint a row with changed; neither shows anything. Pages have up to `limit` rows and, on the last of
    them, the next cursor, where more follows.
    """
    schema = f"fingerprint string, {', '.join(f'`{c}` {matched.schema[c].dataType.simpleString()}' for c in order)}"
    print_ = F.sha2(F.to_json(F.struct("scope", "filter", F.lit(",".join(order)).alias("order"), F.lit(limit).alias("limit"))), 256)
    read = F.from_json(F.try_to_binary("cursor", F.lit("base64")).cast("string"), schema)
    q = req.select("query_id", print_.alias("print"), "cursor", read.alias("c"))
    status = F.when(F.col("cursor").isNull(), "ok").when(F.col("c").isNull() | F.col("c.fingerprint").isNull(), "invalid").when(F.col("c.fingerprint") != F.col("print"), "changed").otherwise("ok")
    q = q.select("query_id", "print", status.alias("status"), *[F.col("c")[c].alias(f"_after{i}") for i, c in enumerate(order)], F.col("cursor").isNull().alias("_first"))
    later = F.col("_first")
    for i, c in enumerate(order):
        here = F.col(c) > F.col(f"_after{i}")
        for j in range(i):
            here &= F.col(order[j]) == F.col(f"_after{j}")
        later |= here
    rows = matched.join(q.filter("status = 'ok'"), "query_id").filter(later)
    numbered = rows.withColumn("no", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("no") <= limit + 1)
    more = numbered.filter(F.col("no") == limit + 1).select("query_id", F.lit(True).alias("_more"))
    cursor = F.base64(F.to_json(F.struct(F.col("print").alias("fingerprint"), *order)).cast("binary"))
    shown = numbered.filter(F.col("no") <= limit).join(more, "query_id", "left").select("query_id", "status", "no", *order, F.when(F.col("_more") & (F.col("no") == limit), cursor).alias("next_cursor"))
    refused = q.filter("status <> 'ok'").select("query_id", "status", F.lit(None).cast("int").alias("no"), *[F.lit(None).cast(matched.schema[c].dataType).alias(c) for c in order], F.lit(None).cast("string").alias("next_cursor"))
    return shown.unionByName(refused)


def trailing_count(rows: DataFrame, key: str, at: str, hours: int) -> DataFrame:
    """Rows of a key in the hours before each row, itself included."""
    w = Window.partitionBy(key).orderBy(F.col(at).cast("timestamp").cast("double")).rangeBetween(-hours * 3600, 0)
    return rows.withColumn("trailing", F.count("*").over(w))


def _rule(pattern: str) -> tuple[str, bool]:
    keep = pattern.startswith("!")
    p = pattern.lstrip("!").strip().lower()
    anchored, folder = "/" in p.rstrip("/"), p.endswith("/")
    body = re.sub(r"\\\*\\\*/?|\\\*|\\\?", lambda m: {"\\*": "[^/]*", "\\?": "[^/]"}.get(m.group(), ".*"), re.escape(p.strip("/")))
    return ("^" if anchored else "^(?:.*/)?") + body + ("/" if folder else "/?") + "$", keep


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ignore rules drop a path: the last match wins, ancestors first; nothing under a dropped folder comes back."""
    rules = [_rule(p) for p in patterns]
    low = F.lower(path)
    parts = F.split(low, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.when(n < F.size(parts), "/").otherwise("")))

    def dropped(p: Column) -> Column:
        out = F.lit(False)
        for regex, keep in rules:  # later rules stand outside earlier ones
            out = F.when(p.rlike(regex), F.lit(not keep)).otherwise(out)
        return out

    return F.exists(prefixes, dropped)


def touching(relationships: DataFrame, elements: DataFrame) -> DataFrame:
    """Relationships at either end of the given elements; elements: snapshot_id, element."""
    ends = relationships.select("*", F.explode(F.array_distinct(F.array("from_element", "to_element"))).alias("element"))
    return ends.join(elements, ["snapshot_id", "element"], "left_semi").select("snapshot_id", "element", "from_element", "to_element")
