"""Code search over texts: literal, regular-expression and path queries, match shaping, file ranges, ranked discovery."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import durable


def lines(corpus: DataFrame) -> DataFrame:
    """One row per line, numbered from 1; an empty text has one empty line."""
    return corpus.select("repository", "path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("no", "line")).withColumn("no", F.col("no") + 1)


def parse_query(query: str) -> tuple[list[str], list[str]]:
    """Terms (quoted phrases whole) and file: patterns of a query."""
    files = [m[1] for m in re.finditer(r"(?:^|\s)file:(\S+)", query)]
    rest = re.sub(r"(?:^|\s)file:\S+", " ", query)
    return [m[1] or m[0] for m in re.finditer(r'"([^"]*)"|\S+', rest)], files


def search(corpus: DataFrame, query: str, regex: bool = False, case: bool = False, context: int = 3, limit: int | None = None) -> DataFrame:
    """Matching lines with preview: all terms must be in the line. Texts that lack a term leave before lines are made."""
    terms, files = parse_query(query)
    if any(re.search(r"\(\?[a-z]*i", t) for t in terms):
        raise ValueError("case is chosen by the parameter, not by inline flags")
    fold = (lambda c: c) if case else F.lower
    has = lambda c, t: c.rlike(("" if case else "(?i)") + t) if regex else fold(c).contains(t if case else t.lower())
    own = corpus
    for f in files:
        own = own.filter(F.col("path").rlike(f))
    for t in terms:
        own = own.filter(has(F.col("text"), t))
    # lines that match are picked inside the array, and previews cut there: no row carries all lines
    line_has = lambda line: F.forall(F.array(*[has(line, t) for t in terms]) if terms else F.array(F.lit(True)), lambda x: x)
    hit = own.select("repository", "path", F.split("text", "\n", -1).alias("_lines"))
    out = _shown(hit.withColumn("_hits", F.filter(_numbered(), lambda x: line_has(x["line"]))), context, ["repository", "path"])
    return out if limit is None else out.orderBy("repository", "path", "line_no").limit(limit)


def _numbered() -> Column:
    return F.transform("_lines", lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))


def _shown(hits: DataFrame, context: int, keep: list[str], more: Callable[[Column], Column] | None = None) -> DataFrame:
    """A row for each of _hits with keep, line_no, preview and what `more` makes of it. hits: _lines, _hits array of (line_no, line)."""
    first = lambda n: F.greatest(n - context, F.lit(1))
    shown = lambda x: F.array_join(F.slice("_lines", first(x["line_no"]), x["line_no"] + 1 + context - first(x["line_no"])), "\n")
    made = F.transform("_hits", lambda x: F.struct(x["line_no"].alias("line_no"), shown(x).alias("preview"), *([more(x["line"]).alias("score")] if more else [])))
    return hits.filter(F.size("_hits") > 0).select(*keep, F.explode(made).alias("_h")).select(*[k.split(".")[-1] for k in keep], "_h.*")


def path_search(corpus: DataFrame, req: DataFrame) -> DataFrame:
    """(query_id, repository, path) of files whose path each request's pattern fits. req: query_id, pattern; a bounded table."""
    return _with_requests(corpus.select("repository", "path"), req.select("query_id", "pattern")).filter(F.regexp_like("path", F.col("r.pattern"))).select("r.query_id", "repository", "path")


#: Requests that one scan answers at most; they travel with every text.
REQUESTS = 10_000


def _with_requests(rows: DataFrame, req: DataFrame, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each row once for each request that keep lets pass, as r. The requests are one broadcast array of bounded length."""
    if req.limit(REQUESTS + 1).count() > REQUESTS:
        raise ValueError(f"at most {REQUESTS} requests at a time")
    all_ = req.agg(F.collect_list(F.struct(*req.columns)).alias("_all"))
    fits = "_all" if keep is None else F.filter("_all", keep)
    return rows.crossJoin(F.broadcast(all_)).withColumn("r", F.explode(fits)).drop("_all")


def parse_requests(req: DataFrame) -> DataFrame:
    """(query_id, terms, files, case, problem) of request texts. req: query_id, text.

    Terms are words and quoted phrases, all of which a line must hold; file:REGEX narrows paths; case:yes makes case count, case:no
    and nothing don't. Inline flags such as (?i) are a problem, and so is a request without terms and files.
    """
    t = F.coalesce("text", F.lit(""))
    filters = r"(?:^|\s)(?:file|case):\S+"
    rest = F.regexp_replace(t, filters, " ")
    terms = F.transform(F.regexp_extract_all(rest, F.lit(r'"[^"]*"|[^\s"]+'), F.lit(0)), lambda x: F.regexp_replace(x, '^"|"$', ""))
    terms = F.filter(terms, lambda x: x != "")
    files = F.regexp_extract_all(t, F.lit(r"(?:^|\s)file:(\S+)"), F.lit(1))
    problem = F.when(F.exists(terms, lambda x: x.rlike(r"\(\?[a-z]*i")), "inline_flag").when((F.size(terms) == 0) & (F.size(files) == 0), "empty")
    return req.select("query_id", terms.alias("terms"), files.alias("files"), (F.lower(F.regexp_extract(t, r"(?:^|\s)case:(\S+)", 1)) == "yes").alias("case"), problem.alias("problem"))


def search_requests(corpus: DataFrame, req: DataFrame, context: int = 3, limit: int = 100, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, repository, path, line_no, preview, score, no, truncated): literal search for a table of requests in one scan.

    req: query_id, text, read by parse_requests; those with a problem find nothing. scope: repository, of those that may be
    searched; an empty scope finds nothing. A text leaves before lines are made unless it holds all terms of a request.
    preview has up to 20 lines of context on both sides; score counts the terms' occurrences in the line. The first `limit`
    matches by score, repository, path and line stay, truncated where there were more.
    """
    context = min(context, 20)
    parsed = parse_requests(req).filter("problem IS NULL AND size(terms) > 0")
    own = corpus if scope is None else corpus.join(F.broadcast(scope.select("repository").distinct()), "repository", "left_semi")
    own = own.select("repository", "path", "text", F.lower("text").alias("low"))
    has = lambda text, low, r: F.forall(r["terms"], lambda t: F.when(r["case"], F.contains(text, t)).otherwise(F.contains(low, F.lower(t))))
    hit = _with_requests(own, parsed, lambda r: has(F.col("text"), F.col("low"), r) & F.forall(r["files"], lambda f: F.regexp_like(F.col("path"), f)))
    hit = hit.select("r", "repository", "path", F.split("text", "\n", -1).alias("_lines"))
    hit = hit.withColumn("_hits", F.filter(_numbered(), lambda x: has(x["line"], F.lower(x["line"]), F.col("r"))))
    times = lambda line, t: F.size(F.split(line, F.concat(F.lit("\\Q"), t, F.lit("\\E")), -1)) - 1
    score = lambda line: F.aggregate("r.terms", F.lit(0), lambda n, t: n + F.when(F.col("r.case"), times(line, t)).otherwise(times(F.lower(line), F.lower(t))))
    return bounded(_shown(hit, context, ["r.query_id", "repository", "path"], score), [F.desc("score"), "repository", "path", "line_no"], limit)


def bounded(matches: DataFrame, order: list[str | Column], limit: int) -> DataFrame:
    """The first `limit` matches of each query with their number, and whether the query had more.

    Matches are kept once. Their number is a count with partial sums, and row numbers are asked under a limit alone, so that
    each task hands on `limit` rows a query: no task sorts all matches of a query.
    """
    matches = durable(matches)
    total = matches.groupBy("query_id").agg((F.count("*") > limit).alias("truncated"))
    first = matches.withColumn("no", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("no") <= limit)
    return first.join(total, "query_id")


def consistent(matches: DataFrame, repositories: DataFrame) -> DataFrame:
    """Matches at the indexed commit of their repository and on its default branch.

    matches: repository, commit, branches array; repositories: name, indexed_sha, default_branch.
    """
    r = repositories.select(F.col("name").alias("repository"), F.col("indexed_sha").alias("commit"), "default_branch")
    return matches.join(r, ["repository", "commit"]).filter(F.array_contains("branches", F.col("default_branch"))).drop("default_branch")


def file_range(corpus: DataFrame, start: int, end: int, most: int) -> DataFrame:
    """Lines start..end of each file: text, whether it was cut at `most` lines, whether the range is outside the file."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    n = min(end - start + 1, most)
    return corpus.select("path", F.array_join(F.slice(parts, F.lit(start), F.lit(n)), "\n").alias("content"), (F.least(F.size(parts), F.lit(end)) - start + 1 > most).alias("truncated"), (F.size(parts) < start).alias("out_of_range"))


def _accents() -> tuple[str, str]:
    """Letters with a mark and their plain letters: whatever of the Latin blocks decomposes into a letter and marks."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


# Words that say nothing in a query.
STOP = ("a", "an", "and", "are", "by", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "what", "when", "where", "which", "with")


def normalise(text: Column) -> Column:
    """Letters without their marks, in lower case."""
    a, b = _accents()
    return F.lower(F.regexp_replace(F.translate(text, a, b), r"\p{M}", ""))


def segments(name: Column) -> Column:
    """Lower-case parts of an identifier of two letters or more: split at anything but letters and digits, and at camel case."""
    a, b = _accents()
    plain = F.regexp_replace(F.translate(name, a, b), r"\p{M}", "")
    cut = F.regexp_replace(F.regexp_replace(plain, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.lower(cut), " "), lambda s: F.char_length(s) >= 2)


def query_terms(text: Column) -> Column:
    """The distinct segments of a query without stop words."""
    return F.array_distinct(F.filter(segments(text), lambda s: ~s.isin(*STOP)))


def segment_vocabulary(nodes: DataFrame) -> DataFrame:
    """Segments of names, of 2 to 32 letters and the first 12 of a name, with how many names hold each."""
    own = F.array_distinct(F.filter(F.slice(segments(F.col("name")), F.lit(1), F.lit(12)), lambda s: F.char_length(s) <= 32))
    return nodes.select("name", F.explode(own).alias("segment")).distinct().groupBy("segment").agg(F.count("*").alias("names"))


def segment_matches(nodes: DataFrame, req: DataFrame, rare: tuple[int, int] = (2, 25)) -> DataFrame:
    """(query_id, name, tier, words): names by the query words whose segments they have, plurals either way. req: query_id, text.

    Tier A: names that cover two words or more. Only where a query has none, tier B: names with a rare segment, one that
    so many names hold, for a word of five letters or more.
    """
    words = req.select("query_id", F.explode(query_terms(F.col("text"))).alias("word"))
    plural = F.array_distinct(F.array_compact(F.array(F.col("word"), F.concat("word", F.lit("s")), F.when(F.endswith("word", F.lit("s")) & (F.char_length("word") > 3), F.substring(F.col("word"), F.lit(1), F.char_length("word") - 1)))))
    words = words.withColumn("segment", F.explode(plural))
    own = F.array_distinct(F.filter(F.slice(segments(F.col("name")), F.lit(1), F.lit(12)), lambda s: F.char_length(s) <= 32))
    held = nodes.select("name", F.explode(own).alias("segment")).distinct()
    n = held.groupBy("segment").agg(F.count("*").alias("names"))
    hit = words.join(held, "segment").join(n, "segment")
    sparse = (F.col("names") >= rare[0]) & (F.col("names") <= rare[1]) & (F.char_length("word") >= 5)
    by = hit.groupBy("query_id", "name").agg(F.countDistinct("word").alias("words"), F.bool_or(sparse).alias("rare"))
    has = F.max(F.col("words") >= 2).over(Window.partitionBy("query_id"))
    tier = F.when(F.col("words") >= 2, "A").when(~F.col("has") & F.col("rare"), "B")
    return by.withColumn("has", has).withColumn("tier", tier).filter("tier IS NOT NULL").select("query_id", "name", "tier", "words")


def project_terms(manifests: DataFrame, repositories: DataFrame) -> DataFrame:
    """(repository, term): names of a project that say nothing inside it: lower letters and digits, five or more.

    manifests: repository, path, body. The repository's name counts, the module of a go.mod, the name of a package.json, and the
    name line of a Cargo.toml or pyproject.toml; of names with slashes the last part.
    """
    leaf = F.regexp_extract("path", "[^/]*$", 0)
    line = lambda p: F.nullif(F.regexp_extract("body", p, 1), F.lit(""))
    name = F.when(leaf == "go.mod", line(r"(?m)^module\s+(\S+)")).when(leaf == "package.json", F.get_json_object("body", "$.name")).when(leaf.isin("Cargo.toml", "pyproject.toml"), line(r'(?m)^name\s*=\s*"([^"]+)"'))
    all_ = manifests.select("repository", name.alias("name")).unionByName(repositories.select(F.col("name").alias("repository"), "name")).filter("name IS NOT NULL")
    term = F.regexp_replace(F.lower(F.regexp_extract("name", "[^/]*$", 0)), "[^a-z0-9]", "")
    return all_.select("repository", term.alias("term")).filter(F.char_length("term") >= 5).distinct()


def without_project_terms(terms: DataFrame, project: DataFrame) -> DataFrame:
    """Query terms but those that name the project. terms: query_id, repository, term."""
    return terms.join(project, ["repository", "term"], "left_anti")
