"""Secrets in texts: fixed patterns, and a randomness test battery with false-discovery control. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

# The patterns of the base scan. The last two find what `AKIA[A-Z0-9]+` of 16 characters or more and
# `[0-9a-f]+` of 32 or more find, without a match for every shorter run.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "random")

#: Runs of the letters of common encodings, of this length at least, are candidates of the battery.
LEAST = 16
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}"

# Alphabets, narrowest first, and the pattern that a string in each has.
ENCODINGS = (
    ("0123456789", "^[0-9]+$"),
    ("0123456789abcdef", "^[0-9a-f]+$"),
    ("0123456789ABCDEF", "^[0-9A-F]+$"),
    ("abcdefghijklmnopqrstuvwxyz", "^[a-z]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "^[A-Z]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "^[A-Z2-7]+$"),
    ("0123456789abcdefghijklmnopqrstuvwxyz", "^[0-9a-z]+$"),
    ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "^[0-9A-Z]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "^[A-Za-z]+$"),
    ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "^[0-9A-Za-z]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "^[A-Za-z0-9+/]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "^[A-Za-z0-9_-]+$"),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", "^"),
)

# How often letters coincide in ordinary strings of each alphabet, as a multiple of random ones. Words keep
# the letter frequencies of language (about 0.065 of pairs coincide) however large the alphabet is; digits and
# hexadecimal digits of ordinary strings repeat and count up.
COINCIDENCE = (1.6, 2.2, 2.2, 1.7, 1.7, 2.2, 2.3, 2.3, 3.2, 3.5, 3.6, 3.6, 3.7)
#: A string whose runs or serial correlation lie further out than this many standard deviations of random ones isn't random.
OUTLYING = 2.8
#: Share of wrong ones that is allowed among the spans that the battery adds.
FALSE_DISCOVERY = 0.05
#: Width of the bins of -ln(p) that the threshold is read from.
BIN = 0.05
_GROUP = 256


def _spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<s,e,m>>: start, end and text of each match; with least, of matches whose group has that length.

    Splitting at the matches gives what lies between them; running sums of both give places in code points. Sums
    are taken over groups of matches and then within each, so that many matches in a text stay cheap.
    """
    p = F.lit(pattern)
    m, between = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    cut = [m.alias("m"), between.alias("b"), *([F.regexp_extract_all(text, p, F.lit(group)).alias("g")] if group else [])]
    size = lambda x: F.struct(F.char_length(x["b"]).alias("skip"), F.char_length(x["m"]).alias("len"), F.char_length(x["g" if group else "m"]).alias("g"), x["m"].alias("m"))
    zipped = lambda c: F.arrays_zip(c["m"].alias("m"), F.slice(c["b"], F.lit(1), F.size(c["m"])).alias("b"), *([c["g"].alias("g")] if group else []))
    step = _let(F.struct(*cut), lambda c: F.transform(zipped(c), size))
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x["skip"] + x["len"])
    groups = _let(step, lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _GROUP).cast("int")), lambda i: F.slice(all_, i * _GROUP + 1, F.lit(_GROUP))))
    none = F.lit(None).cast("array<struct<s:int,e:int,g:int,m:string>>")
    start = F.struct(F.lit(0).alias("at"), F.coalesce(none, F.array().cast("array<struct<s:int,e:int,g:int,m:string>>")).alias("out"))

    def add(a: Column, x: Column) -> Column:
        s = a["at"] + x["skip"]
        e = s + x["len"]
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["g"].alias("g"), x["m"].alias("m")))).alias("out"))

    placed = F.transform(groups, lambda g: F.struct(F.aggregate(g, start, add)["out"].alias("out"), total(g).alias("n")))
    begin = lambda all_: F.aggregate(all_, F.array(F.lit(0)), lambda a, g: F.concat(a, F.array(F.element_at(a, -1) + g["n"])))
    both = _let(placed, lambda all_: F.arrays_zip(all_.alias("g"), F.slice(begin(all_), F.lit(1), F.size(all_)).alias("at")))
    moved = F.transform(both, lambda z: F.transform(z["g"]["out"], lambda x: F.struct((x["s"] + z["at"]).alias("s"), (x["e"] + z["at"]).alias("e"), x["g"].alias("g"), x["m"].alias("m"))))
    found = F.flatten(moved)
    if least:
        found = F.filter(found, lambda x: x["g"] >= least)
    return F.when(text.rlike(pattern), F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once: what a lambda reads of an expression from outside is made anew for each of its elements."""
    return F.transform(F.array(value), use)[0]


def _below(z: Column) -> Column:
    """The normal distribution function; in its lower tail the relative error stays under half a percent."""
    x = F.least(F.abs(z), F.lit(37.0))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) / (0.661 * x + 0.339 * F.sqrt(x * x + 5.51))
    return F.when(z < 0, tail).otherwise(1 - tail)


def surprise(token: Column) -> Column:
    """-ln p of a string: p is how likely an ordinary string of its alphabet and length has letters as even as these.

    The narrowest encoding that holds the string is its alphabet. Its chi-squared statistic against uniform letters is
    about k - 1 for random strings; for ordinary ones, whose letters coincide COINCIDENCE times as often, it is noncentral
    by (n - 1) * (COINCIDENCE - 1). A string is no candidate (0) if the statistic is too large for a random one, or if the runs
    above and below the middle of the alphabet, or the correlation of neighbours, lie outside OUTLYING deviations.
    """
    kind = lambda no: F.struct(F.lit(ENCODINGS[no][0]).alias("letters"), F.lit(COINCIDENCE[no]).alias("often"))
    own = F.when(token.rlike(ENCODINGS[0][1]), kind(0))
    for no in range(1, len(ENCODINGS) - 1):
        own = own.when(token.rlike(ENCODINGS[no][1]), kind(no))
    own = own.otherwise(kind(len(ENCODINGS) - 1))
    codes = lambda a: F.transform(F.split(token, ""), lambda c: (F.instr(a["letters"], c) - 1).cast("double"))
    known = lambda a: F.struct(codes(a).alias("codes"), F.char_length(token).cast("double").alias("n"), F.char_length(a["letters"]).cast("double").alias("k"), a["often"].alias("often"))
    return _let(_let(_let(own, known), _summed), _judged)


def _summed(x: Column) -> Column:
    """What the battery asks of a string's codes: the sum of squared letter counts, runs, moments and how many lie in the upper half."""
    zero = F.lit(0.0)
    squares = F.aggregate(
        F.array_sort(x["codes"]),
        F.struct(F.lit(-1.0).alias("p"), zero.alias("run"), zero.alias("sq")),
        lambda a, c: F.struct(
            c.alias("p"),
            F.when(c == a["p"], a["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
            F.when(c == a["p"], a["sq"] + 2 * a["run"] + 1).otherwise(a["sq"] + 1).alias("sq"),
        ),
    )["sq"]
    half = lambda c: c >= x["k"] / 2
    sums = F.aggregate(
        x["codes"],
        F.struct(F.lit(-1.0).alias("p"), zero.alias("runs"), zero.alias("x"), zero.alias("xx"), zero.alias("xy"), zero.alias("up")),
        lambda a, c: F.struct(
            c.alias("p"),
            (a["runs"] + F.when((a["p"] < 0) | (half(c) != half(a["p"])), F.lit(1.0)).otherwise(zero)).alias("runs"),
            (a["x"] + c).alias("x"),
            (a["xx"] + c * c).alias("xx"),
            (a["xy"] + F.when(a["p"] < 0, zero).otherwise(a["p"] * c)).alias("xy"),
            (a["up"] + F.when(half(c), F.lit(1.0)).otherwise(zero)).alias("up"),
        ),
    )
    return F.struct(x["n"].alias("n"), x["k"].alias("k"), x["often"].alias("often"), squares.alias("squares"), sums.alias("sums"))


def _judged(x: Column) -> Column:
    n, k, squares, sums = x["n"], x["k"], x["squares"], x["sums"]
    chi = k * squares / n - n
    away = (n - 1) * (x["often"] - 1)
    p = _below((chi - (k - 1) - away) / F.sqrt(2 * (k - 1) + 4 * away))
    even = (chi - (k - 1)) / F.sqrt(2 * (k - 1)) < OUTLYING
    up, down = sums["up"], n - sums["up"]
    expect = 2 * up * down / n + 1
    spread = F.sqrt(F.greatest((expect - 1) * (expect - 2) / (n - 1), F.lit(0.25)))
    mixed = (up > 0) & (down > 0) & (F.abs(sums["runs"] - expect) / spread < OUTLYING)
    mean = sums["x"] / n
    variance = sums["xx"] / n - mean * mean
    serial = (sums["xy"] / (n - 1) - mean * mean) / F.greatest(variance, F.lit(1e-9))
    apart = (variance > 0) & (F.abs(serial) * F.sqrt(n) < OUTLYING)
    return F.when(even & mixed & apart, -F.log(F.greatest(p, F.lit(1e-26)))).otherwise(0.0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = FALSE_DISCOVERY) -> DataFrame:
    """(id_col, base, added) per row of docs: arrays of struct<start,kind_no,end,kind>, in that order.

    base has the pattern matches of the whole text, leftmost and non-overlapping per kind; those that fail their least
    length are dropped after they have matched. added has the random-looking runs outside of them: candidates over all
    documents share one false-discovery threshold at q (Benjamini-Hochberg over p-values that are divided by a weight
    which grows with length and has mean 1). Places are code points, ends exclusive.

    p-values say how ordinary a string is (surprise); strings that fail the battery can't be added.

    Row-local but for the threshold, which is read from a histogram of bounded size. Null and empty texts have no
    spans; null ids and repeated rows pass through; an empty table gives an empty result; other columns are ignored.
    """
    text = F.col("_text")
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def of(no: int, a: Column) -> Column:
        return F.transform(a, lambda x: F.struct(x["s"].alias("start"), F.lit(no).alias("kind_no"), x["e"].alias("end"), F.lit(KINDS[no]).alias("kind")))

    rows = src.select(
        "_id",
        F.array_sort(F.concat(of(0, _spans(text, ASSIGN, 2, ASSIGN_LEAST)), of(1, _spans(text, ACCESS)), of(2, _spans(text, HEX)))).alias("base"),
        _spans(text, CANDIDATE).alias("near"),
    )
    outside = F.filter("near", lambda x: ~F.exists("base", lambda b: (b["start"] <= x["s"]) & (x["e"] <= b["end"])))
    rows = rows.select("_id", "base", F.transform(outside, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), surprise(x["m"]).alias("v"))).alias("near"))
    rows = durable(rows)

    weight = lambda x: F.least((x["e"] - x["s"]).cast("double"), F.lit(128.0))
    flat = rows.select(F.explode("near").alias("x")).select(weight(F.col("x")).alias("w"), F.col("x.v").alias("v"))
    m = flat.agg(F.count("*").alias("m"), F.avg("w").alias("w")).first()
    limit = float("inf")
    if m["m"]:
        bins = flat.select(F.floor((F.col("v") + F.log(F.col("w") / m["w"])) / BIN).alias("bin")).groupBy("bin").count().orderBy(F.desc("bin")).collect()
        above = 0
        for r in bins:  # at most a few thousand, whatever the corpus
            above += r["count"]
            if m["m"] * 2.718281828459045 ** (-r["bin"] * BIN) <= q * above:
                limit = r["bin"] * BIN
    keep = F.filter("near", lambda x: F.floor((x["v"] + F.log(weight(x) / (m["w"] or 1.0))) / BIN) * BIN >= limit)
    return rows.select(F.col("_id").alias(id_col), "base", of(3, keep).alias("added"))
