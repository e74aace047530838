"""License evidence, assessment, policy verdicts and review."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import Policy, Terms, normalise, term_key, verdicts

def raw_kind(raw: Column) -> Column:
    """What a raw licence text is: missing, a sentinel, a URL, a file, an expression or a name."""
    t = F.trim(raw)
    return (
        F.when(raw.isNull() | (t == ""), "missing")
        .when(F.upper(t).isin("NOASSERTION", "NONE", "UNLICENSED"), "sentinel")
        .when(t.rlike("(?i)^https?://"), "url")
        .when(F.upper(t).startswith("SEE LICENSE IN "), "file")
        .when(t.rlike(r"^[A-Za-z0-9.+-]+( (AND|OR|WITH) [A-Za-z0-9.+-]+)*$"), "expression")
        .otherwise("name")
    )


def verdict_by_status(rows: DataFrame, policy: Policy, status: str = "status", expression: str = "expression") -> DataFrame:
    """rows with verdict and explanation: resolved and declared ones by the policy, the others by their status."""
    judged = verdicts(rows, expression, policy)
    own = F.when(F.col(status).isin("resolved", "declared"), F.col("verdict")).when(F.col(status) == "conflict", "review_required").when(F.col(status) == "unlicensed", "prohibited").otherwise(policy.unknown)
    return judged.withColumn("explanation", F.when(F.col(status).isin("resolved", "declared"), F.col("explanation")).otherwise(F.concat(F.lit("by status "), F.coalesce(status, F.lit("unassessed"))))).withColumn("verdict", own)


def assess(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Status of each coordinate from all its raw licences: (by, status, expression, detail, fingerprint).

    evidence: the columns `by`, id, source and license_raw. Canonical forms are compared, so that spelling and case make no
    conflict; refusals (none, unlicensed) beside an expression do. An expression that a registry backs (source begins
    with registry_) is resolved, else declared. detail names both sides of a conflict; fingerprint changes with any
    evidence. Sources outrank each other as concluded, declared, then registries by id.
    """
    known = normalise(evidence, "license_raw")
    useful = F.when(F.col("expression_status").isin("parsed", "unknown_terms"), F.col("expression"))
    refusal = F.col("expression_status").isin("none", "unlicensed")
    rank = F.when(F.col("source") == "producer_concluded", 0).when(F.col("source") == "producer_declared", 1).otherwise(2)
    item = F.struct(rank.alias("rank"), "id", "source", F.coalesce(useful, F.when(refusal, F.upper("expression_status"))).alias("says"), F.coalesce("license_raw", F.lit("")).alias("raw"))
    agg = known.groupBy(*by).agg(
        F.countDistinct(useful).alias("kinds"), F.bool_or(refusal).alias("refused"), F.min(useful).alias("one"), F.bool_or(useful.isNotNull() & F.col("source").startswith("registry_")).alias("backed"), F.array_sort(F.collect_set(item)).alias("items")
    )
    conflict = (F.col("kinds") > 1) | ((F.col("kinds") == 1) & F.col("refused"))
    status = F.when(conflict, "conflict").when(F.col("kinds") == 1, F.when(F.col("backed"), "resolved").otherwise("declared")).when(F.col("refused"), "unlicensed").otherwise("unknown")
    said = F.transform(F.filter("items", lambda x: x["says"].isNotNull()), lambda x: F.concat(x["source"], F.lit(": "), x["says"]))
    print_ = F.sha2(F.array_join(F.transform("items", lambda x: F.concat_ws("\x00", x["source"], x["raw"])), "\x00"), 256)
    return agg.select(*by, status.alias("status"), F.when(~conflict & (F.col("kinds") == 1), F.col("one")).alias("expression"), F.when(conflict, F.array_join(F.array_distinct(said), " | ")).alias("detail"), print_.alias("fingerprint"))


def reassess(evidence: DataFrame, changed: DataFrame, by: list[str]) -> DataFrame:
    """assess for the coordinates that changed only. changed: by; may repeat."""
    return assess(evidence.join(changed.select(*by).distinct(), by, "left_semi"), by)


def rule_problems(rules: DataFrame, terms: Terms | None = None) -> DataFrame:
    """(policy_id, class, term, problem) of terms that no policy may hold. rules: policy_id, class, term.

    A term is one licence, one licence with an exception, a reference or *; else it is not_a_term. One that a policy lists
    in another class as well, in whatever spelling, has several_classes.
    """
    known = terms or Terms()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"term": b["term"], "k": [term_key(t, known) for t in b["term"]]})

    r = rules.select("policy_id", "class", "term").distinct()
    r = r.join(r.select("term").distinct().mapInPandas(keys, "term string, k string"), "term")
    classes = r.filter("k IS NOT NULL").groupBy("policy_id", "k").agg(F.countDistinct("class").alias("classes"))
    why = F.when(F.col("k").isNull(), "not_a_term").when(F.col("classes") > 1, "several_classes")
    return r.join(classes, ["policy_id", "k"], "left").select("policy_id", "class", "term", why.alias("problem")).filter("problem IS NOT NULL")


def latest_evidence(rows: DataFrame, key: list[str]) -> DataFrame:
    """The newest row of each key, and the newest resolved one where the newest failed."""
    newest = rows.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("id")))).filter("r = 1").drop("r")
    good = rows.filter("outcome <> 'failed'").withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("id")))).filter("r = 1").drop("r")
    bad = newest.filter("outcome = 'failed'").select(*key)
    return newest.unionByName(good.join(bad, key, "left_semi"))


def changed_evidence(rows: DataFrame, key: list[str], fingerprint: str, order: str) -> DataFrame:
    """Rows whose fingerprint differs from the one before in their key."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_before", F.lag(fingerprint).over(w)).withColumn("_no", F.row_number().over(w)).filter((F.col("_no") == 1) | ~F.col("_before").eqNullSafe(F.col(fingerprint))).drop("_before", "_no")


def superseded(decisions: DataFrame, scope: list[str]) -> DataFrame:
    """Each decision with the one that replaced it; the current one has none."""
    return decisions.withColumn("superseded_by", F.lead("id").over(Window.partitionBy(*scope).orderBy("id")))


def review_queue(components: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """Components that await a decision, with the reason. components: repository_id, name, fingerprint, verdict and more;
    approved ones await none. decisions: repository_id, name, kind, expires_at, fingerprint, id; the newest of each name counts."""
    last = decisions.withColumn("r", F.row_number().over(Window.partitionBy("repository_id", "name").orderBy(F.desc("id")))).filter("r = 1").drop("r")
    open_ = components.filter(F.coalesce("verdict", F.lit("unknown")) != "approved")
    d = open_.join(last.select("repository_id", "name", F.col("kind").alias("decision"), "expires_at", F.col("fingerprint").alias("seen")), ["repository_id", "name"], "left")
    why = (
        F.when(F.col("decision").isNull(), "no decision")
        .when((F.col("decision") == "exception") & (F.col("expires_at") < F.lit(now).cast("timestamp")), "exception expired")
        .when(F.col("seen") != F.col("fingerprint"), "evidence changed")
    )
    return d.withColumn("reason", why).filter("reason IS NOT NULL")


def current_results(results: DataFrame, new: DataFrame) -> DataFrame:
    """Results with new ones added: (key, policy_id, verdict, fingerprint, id, current, version). The newest of a key is current.

    A new result equal to the current one in policy, verdict and fingerprint adds nothing. new has at most one row for each key.
    """
    w = Window.partitionBy("key").orderBy(F.desc("id"))
    now = results.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("policy_id", "verdict", "fingerprint")]
    old = now.select("key", *[F.col(c).alias(f"_{c}") for c in ("policy_id", "verdict", "fingerprint")], F.lit(True).alias("_has"))
    fresh = new.join(old, "key", "left").filter(F.col("_has").isNull() | ~(same[0] & same[1] & same[2])).select(*results.columns)
    all_ = results.unionByName(fresh)
    return all_.withColumn("current", F.row_number().over(w) == 1).withColumn("version", F.row_number().over(Window.partitionBy("key").orderBy("id")))


def conclusion_history(conclusions: DataFrame, current: DataFrame, limit: int = 20) -> DataFrame:
    """(key, id, no, basis_holds): conclusions newest first, with whether their basis is the current fingerprint.

    conclusions: key, id, basis; current: key, fingerprint. Of a key without a fingerprint nothing holds.
    """
    w = Window.partitionBy("key").orderBy(F.desc("id"))
    rows = conclusions.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= limit).join(current.select("key", "fingerprint"), "key", "left")
    return rows.select("key", "id", "no", F.coalesce(F.col("basis") == F.col("fingerprint"), F.lit(False)).alias("basis_holds"))


def event_listing(review: DataFrame, audit: DataFrame, scope: DataFrame, limit: int) -> DataFrame:
    """(listing, id, seen_at): the newest review events of the repositories in scope, and the newest audit events of all."""
    own = review.join(scope.select(F.col("id").alias("repository_id")), "repository_id", "left_semi").orderBy(F.desc("seen_at"), F.desc("id")).limit(limit)
    return own.select(F.lit("review").alias("listing"), "id", "seen_at").unionByName(audit.orderBy(F.desc("seen_at"), F.desc("id")).limit(limit).select(F.lit("audit").alias("listing"), "id", "seen_at"))


def policy_versions(policies: DataFrame) -> DataFrame:
    """(name, id, version, active, conflict): the newest version of each policy name and the state of the name.

    policies: name, version, id, active. active is the newest active version of the name, conflict that several are.
    """
    by = policies.groupBy("name").agg(F.max_by("id", "version").alias("id"), F.max("version").alias("version"), F.max(F.when(F.col("active"), F.col("version"))).alias("active"), F.count_if("active").alias("n"))
    return by.select("name", "id", "version", "active", (F.col("n") > 1).alias("conflict"))


def pending_evaluation(components: DataFrame, results: DataFrame, policies: DataFrame) -> DataFrame:
    """Components without a current result of their repository's active policy for their fingerprint.

    components: key, repository_id, fingerprint; results: key, policy_id, fingerprint; policies: repository_id, policy_id.
    Repositories without a policy have nothing to evaluate.
    """
    r = results.select("key", F.col("policy_id").alias("_policy"), F.col("fingerprint").alias("_seen"))
    c = components.join(policies.select("repository_id", "policy_id"), "repository_id").join(r, "key", "left")
    return c.filter(F.col("_policy").isNull() | (F.col("_policy") != F.col("policy_id")) | ~F.col("_seen").eqNullSafe(F.col("fingerprint"))).select("key", "policy_id", "fingerprint")
