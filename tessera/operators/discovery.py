"""Discovery: ranked symbols for tables of questions in words, over stored postings of weighted fields, with a fuzzy second tier."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import durable

# What kind: and lang: filters may name, words that say nothing, kinds that are entry points, kinds that are weak
# without use, paths of tests, weights of the classes A to D.
KINDS = "file module class struct interface trait protocol function method property field variable constant enum enum_member type_alias namespace parameter import export route component union".split()
LANGUAGES = "typescript javascript tsx jsx arkts python go rust java c cpp csharp razor php ruby swift kotlin dart svelte vue astro liquid pascal scala lua luau objc r solidity nix yaml twig xml properties cfml cfscript cfquery cobol vbnet erlang terraform unknown".split()
STOP = (
    "the a an and or but in on at to for of with by from is it that this are was be has had have do does did will would could should may might can shall not no all each every "
    "how what where when who which why i me my we our you your he she they show give tell been done made used using work works found also into then than just more some such over only out its so up as if "
    "look need needs want happen happens affect affected break breaks failing implemented implement code file files function method class type fix bug called"
).split()
STRONG = "function method class struct union interface trait protocol component route enum type_alias".split()
WEAK = "variable constant parameter property field enum_member".split()
TYPE_KINDS = "interface type_alias enum enum_member namespace".split()
TESTS = r"(?i)(^|/)(__tests__|tests?|specs?|fixtures?|examples?|icons?|i18n)(/|$)|[._](test|spec)[.]|_test[.]"
WEIGHTS = {"A": 1.0, "B": 0.25, "C": 0.1, "D": 0.05}

#: Fields in the order of their places in a node's text, with the class of each; the bit of field k is 1 << k.
FIELDS = (("name", "A"), ("qualified_name", "B"), ("signature", "C"), ("documentation", "D"), ("path", "C"), ("language", "D"), ("kind", "D"))
#: The limit of the sum of 1 / i², which a term's weight is divided by; places of a term that count.
LIMIT, PLACES = 1.64493406685, 256
#: Rows of texts and names, of some 100 bytes, that are broadcast.
FEW = 200_000
#: Terms over so many bytes are looked for whole.
LONG = 1000


@lru_cache(maxsize=1)
def _plain() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, and those letters."""
    pairs = []
    for c in range(0x80, 0x30000):
        left = [x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn"]
        if len(left) == 1 and left[0] != chr(c):
            pairs.append((chr(c), left[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalise(text: Column) -> Column:
    """Lower case without marks; NUL becomes a space. Letters that decompose into several letters (Hangul) stay composed."""
    # most texts are ASCII, which has nothing to take apart
    return F.when(text.rlike(r"^[\x01-\x7F]*$"), F.lower(text)).otherwise(F.lower(F.regexp_replace(F.translate(F.regexp_replace(text, "\x00", " "), *_plain()), r"\p{Mn}", "")))


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def words(text: Column) -> Column:
    """Runs of letters and digits of the normalised text."""
    return _split(normalise(text))


def segments(text: Column) -> Column:
    """Runs of letters and digits, cut where a word begins inside an identifier (fooBar, HTMLParser), normalised."""
    return _split(normalise(F.regexp_replace(text, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")))


def document(text: Column) -> Column:
    """The terms of a field in order: its words, then its segments."""
    lexeme = lambda w: F.when(F.octet_length(w) > LONG, F.concat(F.lit("long"), F.sha2(w, 256))).otherwise(w)
    value = F.coalesce(text, F.lit(""))
    return F.transform(F.concat(words(value), segments(value)), lexeme)


def variants(term: Column) -> Column:
    """A term and what it may be a form of: endings -ing, -tion, -sion, -ment, -ies, -es, -s, -ed and -er taken off or undone."""
    size = F.octet_length(term)
    cut = lambda n: F.substring(term, F.lit(1), F.char_length(term) - n)
    last = lambda n: F.substring(term, F.char_length(term) - n, F.lit(1))  # noqa: E731  the letter before the last n
    on = lambda end, least: F.endswith(term, F.lit(end)) & (size > least)
    ing, er, ed = on("ing", 5), on("er", 4), on("ed", 4) & ~F.endswith(term, F.lit("eed"))
    ies, es = on("ies", 4), on("es", 4) & ~F.endswith(term, F.lit("ies"))
    s = on("s", 4) & ~F.endswith(term, F.lit("es")) & ~F.endswith(term, F.lit("ss"))
    made = [
        F.when(ing, cut(3)), F.when(ing, F.concat(cut(3), F.lit("e"))), F.when(ing & (last(3) == last(4)), cut(4)),
        F.when(on("tion", 5) | on("sion", 5), cut(3)), F.when(on("ment", 6), cut(4)),
        F.when(ies, F.concat(cut(3), F.lit("y"))), F.when(es, cut(2)), F.when(es | s, cut(1)),
        F.when(ed, cut(1)), F.when(ed, cut(2)),
        F.when(er, cut(2)), F.when(er, F.concat(cut(2), F.lit("e"))), F.when(er & (last(2) == last(3)), cut(3)),
    ]
    return F.array_distinct(F.concat(F.array(term), F.filter(F.array(*made), lambda v: F.octet_length(v) >= 3)))


def project_token(text: Column) -> Column:
    """Letters and digits alone, normalised."""
    return F.regexp_replace(normalise(text), r"[^\p{L}\p{Nd}]", "")


def _terms(word: Column, project: Column) -> Column:
    """Terms of one word of a question: none if it names the project."""
    each = F.filter(F.concat(words(word), segments(word)), lambda t: (F.octet_length(t) >= 2) & ~t.isin(*STOP))
    return F.when(F.array_contains(project, project_token(word)), F.array().cast("array<string>")).otherwise(F.array_distinct(F.flatten(F.transform(each, variants))))


def parse(req: DataFrame) -> DataFrame:
    """(query_id, text, kinds, languages, paths, names) of questions. req: query_id, text.

    Tokens are runs without white space, quoted parts whole. kind:, lang: or language:, path: and name: are filters, several of one name
    are alternatives; a token with an unknown key, kind or language, or without a value, stays part of the text.
    """
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r'(?:[^\s"]|"[^"]*"|"[^"]*$)+'), F.lit(0))
    value = lambda t: F.regexp_replace(F.regexp_extract(t, "(?s)^[^:]*:(.*)$", 1), '(?s)^"(.*)"$', "$1")
    cut = F.transform(tokens, lambda t: F.struct(t.alias("token"), F.when(F.contains(t, F.lit(":")), F.lower(F.substring_index(t, ":", 1))).otherwise("").alias("key"), value(t).alias("value")))
    is_ = {
        "kinds": lambda t: (t["key"] == "kind") & t["value"].isin(*KINDS),
        "languages": lambda t: t["key"].isin("lang", "language") & F.lower(t["value"]).isin(*LANGUAGES),
        "paths": lambda t: (t["key"] == "path") & (t["value"] != ""),
        "names": lambda t: (t["key"] == "name") & (t["value"] != ""),
    }
    made = {"kinds": lambda t: t["value"], "languages": lambda t: F.lower(t["value"]), "paths": lambda t: normalise(t["value"]), "names": lambda t: normalise(t["value"])}
    rest = F.array_join(F.transform(F.filter("cut", lambda t: ~(is_["kinds"](t) | is_["languages"](t) | is_["paths"](t) | is_["names"](t))), lambda t: t["token"]), " ")
    return req.withColumn("cut", cut).select("query_id", rest.alias("text"), *[F.transform(F.filter("cut", is_[k]), made[k]).alias(k) for k in is_])


def plan(req: DataFrame) -> DataFrame:
    """What ranked search needs of each question. req: query_id, text, and optional arrays symbols, files (wanted by name) and project.

    raw is the normalised text; groups holds the terms of each different word, terms all of them; symbols and files are the names
    and paths asked for and all whole words of the text that don't name the project. A text of one character is its own term.
    """
    none = F.array().cast("array<string>")
    given = {c: F.coalesce(F.transform(c, normalise), none) if c in req.columns else none for c in ("symbols", "files")}
    project = F.filter(F.transform("project", project_token), lambda t: F.octet_length(t) >= 5) if "project" in req.columns else none
    q = parse(req.select("query_id", "text")).join(req.select("query_id", given["symbols"].alias("wanted_symbols"), given["files"].alias("wanted_files"), F.coalesce(project, none).alias("project")), "query_id")
    q = q.withColumn("raw", normalise(F.col("text"))).withColumn("single", F.char_length("raw") == 1)
    spaced = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    first = F.filter(spaced, lambda w, i: F.array_position(F.transform(spaced, normalise), normalise(w)) == i + 1)
    groups = F.filter(F.transform(first, lambda w: _terms(w, F.col("project"))), lambda g: F.size(g) > 0)
    q = q.withColumn("groups", F.when(F.col("single"), F.array(F.array("raw"))).otherwise(groups)).withColumn("terms", F.array_distinct(F.flatten("groups")))
    whole = F.filter(F.regexp_extract_all("text", F.lit(r'(?:[^\s"]|"[^"]*"|"[^"]*$)+'), F.lit(0)), lambda w: (F.octet_length(w) >= 2) | F.col("single"))
    whole = F.filter(F.transform(whole, lambda w: normalise(F.regexp_replace(w, '^"+|"+$', ""))), lambda w: ~F.array_contains("project", project_token(w)))
    return q.withColumn("whole", whole).select(
        "query_id", "text", "raw", "single", "kinds", "languages", "paths", "names", "terms", "groups", "wanted_symbols", "wanted_files",
        F.concat("wanted_symbols", "whole").alias("symbols"), F.concat("wanted_files", "whole").alias("files"),
    )


def grams(text: Column) -> Column:
    """Different runs of one to three characters."""
    n = F.char_length(text)
    runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, k))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 3))), runs)))


def ambient_paths(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(path) of files that hold type declarations alone: nothing there calls or instantiates, nothing elsewhere refers to them, and
    their extraction had no errors. files: path, and optionally errors."""
    own = nodes.filter("coalesce(path, '') <> ''")
    declared = own.filter(~F.col("kind").isin("file", "import", "export", "parameter")).groupBy("path").agg(F.bool_and(F.col("kind").isin(*TYPE_KINDS)).alias("typed"))
    end = lambda c: own.select(F.col("occurrence").alias(c), F.col("path").alias(f"{c}_path"))
    active = edges.filter("kind IN ('calls', 'instantiates')").select("source").join(end("source"), "source").select(F.col("source_path").alias("path"))
    seen = edges.select("source", "target").join(end("source"), "source").join(end("target"), "target").filter("source_path <> target_path").select(F.col("target_path").alias("path"))
    good = files.filter("errors IS NULL") if "errors" in files.columns else files
    return declared.filter("typed").select("path").join(active.unionByName(seen).distinct(), "path", "left_anti").join(good.select("path").distinct(), "path", "left_semi")


def projection(nodes: DataFrame, edges: DataFrame, files: DataFrame, generated_name: str, tests: str = TESTS) -> DataFrame:
    """What discovery reads of each node, to be stored once: (occurrence, kind, normalised fields, grams, usage, generated, ambient, test).

    nodes: occurrence, kind, name, qualified_name, path, language and optionally signature, documentation. usage counts edge ends other
    than contains, imports and exports, a loop once. A file is generated by its flag or by a name that generated_name fits.
    """
    ends = edges.filter("kind NOT IN ('contains', 'imports', 'exports')")
    usage = ends.select(F.col("source").alias("occurrence")).unionByName(ends.filter("source <> target").select(F.col("target").alias("occurrence"))).groupBy("occurrence").agg(F.count("*").alias("usage"))
    for c in ("signature", "documentation"):
        nodes = nodes if c in nodes.columns else nodes.withColumn(c, F.lit(None).cast("string"))
    flags = files.groupBy("path").agg(F.bool_or(F.coalesce("generated", F.lit(False))).alias("generated")).join(ambient_paths(nodes, edges, files).withColumn("ambient", F.lit(True)), "path", "left")
    n = nodes.select("occurrence", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "qualified_name", "signature", "documentation", "path", "language")])
    n = n.join(usage, "occurrence", "left").join(flags, "path", "left")
    texts = ("name", "qualified_name", "signature", "documentation", "path")
    # the normalised fields are columns before grams are made of them: a lambda would make them anew for each gram
    low = n.select(
        "occurrence", "kind", *[normalise(F.col(c)).alias(c) for c in (*texts, "language")], F.coalesce("usage", F.lit(0)).alias("usage"),
        (F.coalesce("generated", F.lit(False)) | F.col("path").rlike(generated_name)).alias("generated"), F.coalesce("ambient", F.lit(False)).alias("ambient"), F.col("path").rlike(tests).alias("test"),
    )
    return low.withColumn("every", F.concat_ws(" ", *texts)).withColumn("grams", grams(F.col("every"))).drop("every")


def postings(nodes: DataFrame) -> DataFrame:
    """(term, occurrence, weight, fields), to be stored once: each term of a node with its share of the rank and the bits of its fields.

    A node's text is its fields in order. A term's places have the weights of their fields' classes; its share is the largest weight plus
    the sum of weight / number² over the other places, numbered from 1 in order, divided by the limit of the sum of 1 / i².
    """
    for c in ("signature", "documentation"):
        nodes = nodes if c in nodes.columns else nodes.withColumn(c, F.lit(None).cast("string"))
    named = lambda k, c: F.transform(document(F.col(c)), lambda t: F.struct(t.alias("term"), F.lit(k).alias("field")))
    each = nodes.select("occurrence", F.explode(F.concat(*[named(k, c) for k, (c, _) in enumerate(FIELDS)])).alias("t")).select("occurrence", "t.term", "t.field")
    counted = each.groupBy("occurrence", "term").agg(*[F.count_if(F.col("field") == k).cast("int").alias(f"n{k}") for k in range(len(FIELDS))])
    places = F.slice(F.concat(*[F.array_repeat(F.lit(WEIGHTS[w]), F.least(F.col(f"n{k}"), F.lit(PLACES))) for k, (_, w) in enumerate(FIELDS)]), 1, PLACES)
    best, at = F.array_max("places"), F.array_position("places", F.array_max("places"))
    total = F.aggregate(F.transform("places", lambda w, i: w / ((i + 1) * (i + 1))), F.lit(0.0), lambda a, x: a + x)
    bits = sum((F.when(F.col(f"n{k}") > 0, 1 << k).otherwise(0) for k in range(len(FIELDS))), F.lit(0))
    return counted.withColumn("places", places).select("term", "occurrence", ((best + total - best / (at * at)) / LIMIT).alias("weight"), bits.alias("fields"))


def _expanded(post: DataFrame, asked: DataFrame) -> DataFrame:
    """(term, lexeme): the stored terms that each asked term begins. They meet by their first two characters, or by one where one is asked."""
    stored = post.select(F.col("term").alias("lexeme")).distinct()
    heads = stored.withColumn("head", F.explode(F.array_distinct(F.array(F.substring("lexeme", 1, 1), F.substring("lexeme", 1, 2)))))
    asked = asked.select("term").distinct().withColumn("head", F.substring("term", 1, 2))
    fits = F.when(F.octet_length("term") > LONG, F.col("lexeme") == F.concat(F.lit("long"), F.sha2("term", 256))).otherwise(F.startswith("lexeme", F.col("term")))
    short = asked.filter(F.octet_length("term") <= LONG).join(heads, "head").filter(fits).select("term", "lexeme")
    whole = asked.filter(F.octet_length("term") > LONG).select("term", F.concat(F.lit("long"), F.sha2("term", 256)).alias("lexeme")).join(stored, "lexeme").select("term", "lexeme")
    return short.unionByName(whole)


def top(df: DataFrame, key: str, order: list[Column], k: int, name: str = "r") -> DataFrame:
    """The first k rows of each key, numbered. Nothing else is asked of the window, so that each task keeps k rows a key before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(name) <= k)


def discover(projected: DataFrame, post: DataFrame, req: DataFrame, limit: int = 20, candidates: int = 0, deprioritised: Column | None = None, multiterm: bool = True) -> DataFrame:
    """Ranked symbols: (query_id, occurrence, r, pinned, fuzzy, edit_distance, corroborated, matched, fields, score, entry, named).

    projected and post are the stored tables of `projection` and `postings`; req as in `plan`. Candidates are nodes within a question's filters
    that have a term which begins with one of its terms, whose name or path is wanted or is a word of the text, or one of whose five
    texts holds the whole text; for a question of filters alone, all within them. Where a question finds none and has three characters or
    more, names within edit distance 2 (1 up to four characters) are candidates instead.

    score = (1 + 100 * rank + 0.2 * min(usage, 20)) / (1 + distance), times 0.25 where deprioritised (a condition on path), 0.08 for an
    unused variable, constant, parameter, property, field or enum member, 0.5 for a file, import or export, and, unless name or path is
    wanted or a word of the text, the lesser of 0.3 (generated) and 0.5 (ambient), times 0.5 for a test. rank is the mean over the
    question's terms of the shares of what they begin. pinned: wanted by name or path, or a word of the text and not
    deprioritised. corroborated: two words of the text found on a used node or entry kind without any penalty.

    Of the first `candidates` (at least 100 and five times the limit) by pinned, distance, corroborated, score and hash of the
    occurrence, the first `limit` by distance, pinned, corroborated, score and occurrence stay. entry and named are what
    `confidence` reads.
    """
    candidates = candidates or max(100, 5 * limit)
    q = durable(plan(req))
    asked = q.select("query_id", F.size("terms").alias("n"), F.posexplode("groups").alias("g", "t")).select("query_id", "n", "g", F.explode("t").alias("term"))
    by_term = _expanded(post, asked).join(post.withColumnRenamed("term", "lexeme"), "lexeme").groupBy("term", "occurrence").agg(F.sum("weight").alias("w"), F.bit_or("fields").alias("f"))
    found = asked.join(by_term, "term")
    # a term of several words counts once for the rank, and once for each word that it belongs to
    ranked = found.groupBy("query_id", "occurrence").agg(F.countDistinct("g").alias("matched"), F.bit_or("f").alias("f"))
    rank = found.select("query_id", "n", "term", "occurrence", "w").distinct().groupBy("query_id", "occurrence").agg((F.sum("w") / F.max("n")).alias("rank"))
    key = ["query_id", "occurrence"]
    ranked = ranked.join(rank, key)
    # names and paths by equality, whole texts by a gram of theirs
    wish = lambda c, to: q.select("query_id", F.explode(F.array_distinct(c)).alias(to)).join(projected.select(to, "occurrence"), to).select(*key)
    probe = q.filter("raw <> ''").select("query_id", "raw", F.substring("raw", 1, 3).alias("gram"))
    probes = probe.agg(F.collect_set("gram").alias("probes"))
    five = ("name", "qualified_name", "signature", "documentation", "path")
    inside = projected.select("occurrence", *five, "grams").crossJoin(F.broadcast(probes)).withColumn("gram", F.explode(F.array_intersect("grams", "probes"))).join(F.broadcast(probe), "gram")
    holds = sum((F.when(F.contains(F.col(c), F.col("raw")), 1 << k).otherwise(0) for k, c in enumerate(five)), F.lit(0))
    inside = inside.select(*key, holds.alias("i")).filter("i > 0")
    blank = q.filter("text = '' AND size(symbols) = 0 AND size(files) = 0 AND size(kinds) + size(languages) + size(paths) + size(names) > 0")
    passes = lambda: (
        ((F.size("kinds") == 0) | F.array_contains("kinds", F.col("kind"))) & ((F.size("languages") == 0) | F.array_contains("languages", F.col("language")))
        & ((F.size("paths") == 0) | F.exists("paths", lambda p: F.contains(F.col("path"), p))) & ((F.size("names") == 0) | F.exists("names", lambda p: F.contains(F.col("name"), p)))
    )
    facts = projected.drop("grams", "qualified_name", "signature", "documentation")
    asks = F.broadcast(q.select("query_id", "kinds", "languages", "paths", "names", "terms", "raw", "symbols", "files", "wanted_symbols", "wanted_files"))
    listed = facts.select("occurrence", "kind", "language", "path", "name").join(F.broadcast(blank.select("query_id", "kinds", "languages", "paths", "names")), passes()).select(*key)
    all_ = ranked.join(inside, key, "full")
    more = wish("symbols", "name").unionByName(wish("files", "path")).unionByName(listed).distinct()
    all_ = all_.join(more.withColumn("m", F.lit(1)), key, "full").join(facts, "occurrence").join(asks, "query_id").filter(passes())

    low = F.lit(False) if deprioritised is None else F.coalesce(deprioritised, F.lit(False))
    one = F.lit(1.0)
    says = F.array_contains("symbols", F.col("name")) | F.array_contains("files", F.col("path"))
    wanted = F.array_contains("wanted_symbols", F.col("name")) | F.array_contains("wanted_files", F.col("path"))
    rest = F.when(says, one).otherwise(F.least(F.when(F.col("generated"), 0.3).otherwise(one), F.when(F.col("ambient"), 0.5).otherwise(one)) * F.when(F.col("test"), 0.5).otherwise(one))
    kind = F.when(F.col("kind").isin(*WEAK) & (F.col("usage") == 0), 0.08).when(F.col("kind").isin("file", "import", "export"), 0.5).otherwise(one)
    score = (1 + 100 * F.coalesce("rank", F.lit(0.0)) + 0.2 * F.least("usage", F.lit(20))) * rest * F.when(low, 0.25).otherwise(one) / (1 + F.col("edit_distance")) * kind
    strong = F.col("kind").isin(*STRONG) | (F.col("usage") > 0)
    matched = F.coalesce("matched", F.lit(0).cast("long"))
    clean = ~F.col("generated") & ~F.col("ambient") & ~F.col("test") & ~low
    bits = F.coalesce("f", F.lit(0)).bitwiseOR(F.coalesce("i", F.lit(0))).bitwiseOR(F.when(F.col("fuzzy"), 1).otherwise(0)).bitwiseOR(F.when(F.array_contains("kinds", F.col("kind")), 64).otherwise(0)).bitwiseOR(F.when(F.array_contains("languages", F.col("language")), 32).otherwise(0))
    names = F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << k)) > 0, FIELDS[k][0]) for k in (0, 1, 2, 3, 4, 6, 5)]))
    pinned = wanted | (says & ~low)
    score_of = lambda rows: rows.select(
        *key, pinned.alias("pinned"), "fuzzy", "edit_distance", (clean & strong & (matched >= 2) & F.lit(multiterm)).alias("corroborated"), matched.alias("matched"), names.alias("fields"), F.round(score, 9).alias("score"),
        ((pinned & F.array_contains("files", F.col("path"))) | wanted | (F.size("terms") == 0) & (F.col("raw") == "") | (F.size("terms") > 0) & strong).alias("entry"), (pinned & F.array_contains("symbols", F.col("name"))).alias("named"),
    )
    # what is kept of the first tier are its few columns; the second needs to know which questions found something
    scored = durable(score_of(all_.withColumn("edit_distance", F.lit(0)).withColumn("fuzzy", F.lit(False))))
    near = fuzzy(projected.select("name", "occurrence"), q.select("query_id", F.col("raw").alias("text")), scored)
    second = near.join(facts, "occurrence").join(asks, "query_id").filter(passes()).withColumn("fuzzy", F.lit(True))
    second = second.withColumns({"rank": F.lit(None).cast("double"), "matched": F.lit(None).cast("long"), "f": F.lit(None).cast("int"), "i": F.lit(None).cast("int")})
    scored = scored.unionByName(score_of(second))
    first = top(scored, "query_id", [F.desc("pinned"), F.col("edit_distance"), F.desc("corroborated"), F.desc("score"), F.sha2("occurrence", 256)], candidates, "c")
    return top(first, "query_id", [F.col("edit_distance"), F.desc("pinned"), F.desc("corroborated"), F.desc("score"), F.col("occurrence")], limit).drop("c")


def fuzzy(names: DataFrame, req: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(query_id, occurrence, edit_distance) of names within edit distance 1 (up to four characters) or 2 of questions that found nothing.

    names: occurrence, name; req: query_id, text of three characters or more; found: query_id. d edits leave one of d + 1 pieces of a
    name whole, at most d places away: names and questions meet by (length, piece, text of the piece), and only those pairs
    are measured.
    """
    asks = req.filter(F.char_length("text") >= 3).select("query_id", "text")
    asks = durable(asks if found is None else asks.join(found.select("query_id").distinct(), "query_id", "left_anti"))
    q = asks.select("text").distinct().withColumn("d", F.when(F.char_length("text") <= 4, 1).otherwise(2))
    size = lambda n, d, i: (F.floor(n * (i + 1) / (d + 1)) - F.floor(n * i / (d + 1))).cast("int")
    at = lambda n, d, i: F.floor(n * i / (d + 1)).cast("int")
    n, d, i = F.col("n"), F.col("d"), F.col("i")
    own = names.select("name").distinct().withColumn("n", F.char_length("name")).filter("n >= 1").withColumn("d", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("i", F.explode(F.sequence(F.lit(0), d)))
    own = own.select("name", "n", "d", "i", F.substring(F.col("name"), at(n, d, i) + 1, size(n, d, i)).alias("piece"))
    q = q.withColumn("n", F.explode(F.sequence(F.greatest(F.char_length("text") - d, F.lit(1)), F.char_length("text") + d))).withColumn("i", F.explode(F.sequence(F.lit(0), d))).withColumn("move", F.explode(F.sequence(-d, d)))
    start = at(n, d, i) + F.col("move")
    q = q.filter(start >= 0).select("text", "n", "d", "i", F.substring(F.col("text"), start + 1, size(n, d, i)).alias("piece")).distinct()
    near = q.join(own, ["n", "d", "i", "piece"]).select("text", "name", "d").distinct()
    near = durable(near.withColumn("edit_distance", F.levenshtein("text", "name")).filter("edit_distance <= d").drop("d"))
    # a pair of text and name is measured once, whoever asks and whatever has the name; neither is dealt by the few texts and names
    near = asks.join(_small(near), "text").select("query_id", "name", "edit_distance")
    small = near.limit(FEW + 1).count() <= FEW
    return names.join(F.broadcast(near) if small else near, "name").select("query_id", "occurrence", "edit_distance")


def _small(df: DataFrame) -> DataFrame:
    """A durable table of narrow rows, broadcast where it has FEW rows or less."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def confidence(req: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, status, confidence) of questions and what `discover` found for them.

    candidates where something found is an entry point (wanted, a file named in the text, within a question of filters alone, or
    found by terms and of an entry kind or used) or is pinned by its name, or the text is one character; else no_entry_point.
    discovery_only where there is an entry point for a text that isn't one character, else low.
    """
    by = found.groupBy("query_id").agg(F.bool_or("entry").alias("entry"), F.bool_or("named").alias("named"))
    q = plan(req).select("query_id", "single").join(by, "query_id", "left")
    entry, some = F.coalesce("entry", F.lit(False)), F.coalesce(F.col("named") | F.col("single"), F.lit(False))
    return q.select("query_id", F.when(entry | some, "candidates").otherwise("no_entry_point").alias("status"), F.when(entry & ~F.col("single"), "discovery_only").otherwise("low").alias("confidence"))
