"""License expressions: each distinct string is parsed once into a tree; canonical text, terms and policy verdicts come of it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Families of licences by strictness, loosest first, and well-known licences of each family.
FAMILIES = ("permissive", "unknown", "other", "weak_copyleft", "strong_copyleft")
FAMILY = {
    "permissive": (
        "MIT", "MIT-0", "Apache-2.0", "Apache-1.1", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause-Clear", "0BSD", "ISC", "Zlib", "Unlicense", "CC0-1.0",
        "BSL-1.0", "PostgreSQL", "Python-2.0", "PSF-2.0", "X11", "WTFPL", "Unicode-DFS-2016", "Unicode-3.0", "BlueOak-1.0.0", "CC-BY-4.0", "NCSA", "curl",
        "AFL-3.0", "Artistic-2.0", "OpenSSL",
    ),
    "weak_copyleft": (
        "LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
        "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "CDDL-1.1", "CPL-1.0", "MS-RL",
    ),
    "strong_copyleft": (
        "GPL-1.0", "GPL-1.0-only", "GPL-1.0-or-later", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later",
        "AGPL-1.0", "AGPL-1.0-only", "AGPL-1.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "SSPL-1.0",
    ),
}
EXCEPTIONS = ("Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Bison-exception-2.2", "Autoconf-exception-3.0", "OpenSSL-exception")
VERDICTS = ("approved", "review_required", "unknown", "prohibited")


@dataclass
class Terms:
    """The licences and exceptions that count as known, by their lower-case form. Names without -only are deprecated."""

    licenses: dict[str, str] = field(default_factory=lambda: {x.lower(): x for ids in FAMILY.values() for x in ids})
    exceptions: dict[str, str] = field(default_factory=lambda: {x.lower(): x for x in EXCEPTIONS})

    @classmethod
    def of(cls, licenses: list[str], exceptions: list[str]) -> Terms:
        """A list of your own, such as a whole release of the licence list."""
        return cls({x.lower(): x for x in licenses}, {x.lower(): x for x in exceptions})

    def deprecated(self, id_: str) -> bool:
        return f"{id_}-only".lower() in self.licenses


@dataclass
class Node:
    """kind: license, reference, with, and, or. A licence knows whether it is listed and whether later versions count."""

    kind: str
    id: str = ""
    known: bool = True
    later: bool = False
    exception: str = ""
    parts: list[Node] = field(default_factory=list)

    def text(self, inside: str = "") -> str:
        if self.kind in ("and", "or"):
            out = f" {self.kind.upper()} ".join(p.text(self.kind) for p in self.parts)
            return f"({out})" if inside and inside != self.kind and not (inside == "or" and self.kind == "and") else out
        out = self.id + ("+" if self.later else "")
        return f"{out} WITH {self.exception}" if self.kind == "with" else out

    def leaves(self) -> Iterator[Node]:
        if self.parts:
            for p in self.parts:
                yield from p.leaves()
        else:
            yield self


_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+:-]+)")
_WORDS = ("AND", "OR", "WITH")
_DEPTH, _LENGTH = 32, 4096


def parse(raw: str | None, terms: Terms) -> tuple[str, Node | None]:
    """(status, tree): no_assertion, none, unlicensed, invalid, unknown_terms or parsed. OR binds loosest, then AND, WITH."""
    text = (raw or "").strip()
    if not text or text.upper() == "NOASSERTION":
        return "no_assertion", None
    if text.upper() in ("NONE", "UNLICENSED"):
        return text.lower(), None
    tokens, at = [], 0
    while at < len(text) and len(text) <= _LENGTH:
        m = _TOKEN.match(text, at)
        if not m:
            return "invalid", None
        tokens.append(m.group(1))
        at = m.end()
    tokens.append("")
    spot = 0

    def word() -> str:
        return tokens[spot].upper() if tokens[spot].upper() in _WORDS else tokens[spot] if tokens[spot] in ("(", ")", "") else "name"

    def name() -> str:
        nonlocal spot
        if word() != "name":
            raise ValueError
        spot += 1
        return tokens[spot - 1]

    def single(depth: int) -> Node:
        nonlocal spot
        if word() == "(" and depth < _DEPTH:
            spot += 1
            inner = chain("or", depth + 1)
            if word() != ")":
                raise ValueError
            spot += 1
            return inner
        own = name()
        if own.lower().startswith(("licenseref-", "documentref-")):
            node = Node("reference", own)
        else:
            later = own.endswith("+") and own.lower() not in terms.licenses
            id_ = own[:-1] if later else own
            node = Node("license", terms.licenses.get(id_.lower(), id_), id_.lower() in terms.licenses, later)
        if word() == "WITH":
            spot += 1
            e = name()
            node = Node("with", node.id, node.known and e.lower() in terms.exceptions, node.later, terms.exceptions.get(e.lower(), e))
        return node

    def chain(kind: str, depth: int) -> Node:
        nonlocal spot
        below = (lambda: chain("and", depth)) if kind == "or" else (lambda: single(depth))
        parts = [below()]
        while word() == kind.upper():
            spot += 1
            parts.append(below())
        if len(parts) == 1:
            return parts[0]
        flat = [q for p in parts for q in (p.parts if p.kind == kind else [p])]
        return Node(kind, parts=flat)

    try:
        tree = chain("or", 0)
    except ValueError:
        return "invalid", None
    if tokens[spot]:
        return "invalid", None
    return ("parsed" if all(x.known for x in tree.leaves()) else "unknown_terms"), tree


def canonical(raw: str | None, terms: Terms | None = None) -> tuple[str, str | None]:
    """(status, canonical text): listed names in their own case, operators in capitals, spare brackets gone."""
    status, tree = parse(raw, terms or Terms())
    return status, tree.text() if tree else None


def normalise(rows: DataFrame, column: str, terms: Terms | None = None) -> DataFrame:
    """rows with expression_status, expression, expression_terms, unknown_terms, license_references and deprecated_terms (arrays)."""
    known = terms or Terms()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw in b["_raw"]:
                status, tree = parse(raw, known)
                leaves = list(tree.leaves()) if tree else []
                pick = lambda f, leaves=leaves: sorted({x.text() for x in leaves if f(x)})
                out.append((raw, status, tree.text() if tree else None, pick(lambda x: True), pick(lambda x: not x.known), pick(lambda x: x.kind == "reference"), pick(lambda x: x.kind != "reference" and known.deprecated(x.id))))
            yield pd.DataFrame(out, columns=["_raw", "expression_status", "expression", "expression_terms", "unknown_terms", "license_references", "deprecated_terms"])

    lists = ", ".join(f"{c} array<string>" for c in ("expression_terms", "unknown_terms", "license_references", "deprecated_terms"))
    found = rows.select(F.col(column).alias("_raw")).distinct().mapInPandas(run, f"_raw string, expression_status string, expression string, {lists}")
    return rows.join(found, rows[column].eqNullSafe(found["_raw"]), "left").drop("_raw")


def term_key(term: str, terms: Terms) -> str | None:
    """The lower-case canonical form of a policy's term: a licence, a licence with an exception, a reference or *."""
    t = term.strip()
    if t == "*":
        return t
    status, tree = parse(t, terms)
    if tree is None or tree.kind in ("and", "or") or status != "parsed":
        return None
    return tree.text().lower()


def rule_problems(rules: dict[str, list[str]], terms: Terms | None = None) -> list[tuple[str, str, str]]:
    """(class, term, problem) of terms that no policy may hold: not_a_term, or several_classes."""
    known, seen, out = terms or Terms(), {}, []
    for cls, listed in rules.items():
        for t in listed:
            key = term_key(t, known)
            if key is None:
                out.append((cls, t, "not_a_term"))
            elif seen.setdefault(key, cls) != cls:
                out.append((cls, t, "several_classes"))
    return out


class Policy:
    """Verdicts over expression trees. rules: class → terms; the classes are approved, review_required and prohibited."""

    def __init__(self, rules: dict[str, list[str]], or_later: bool = False, unknown: str = "unknown", terms: Terms | None = None):
        self.terms, self.or_later, self.unknown = terms or Terms(), or_later, unknown
        self.by_term: dict[str, str] = {}
        for cls in ("prohibited", "review_required", "approved"):
            for t in rules.get(cls, ()):
                if (key := term_key(t, self.terms)) is not None:
                    self.by_term[key] = cls

    def leaf(self, n: Node) -> str:
        listed = self.by_term.get(n.text().lower())
        if listed:
            return listed
        if n.kind == "reference":
            return self.by_term.get("*", self.unknown)
        if not n.known:
            return self.unknown
        if n.kind == "with":  # an exception changes the terms: its licence alone can't approve it
            return "review_required"
        base = [n.id] * n.later + [n.id.removesuffix("-or-later") + "-only"] * n.id.endswith("-or-later")
        return next((v for b in base if self.or_later and (v := self.by_term.get(b.lower()))), self.unknown)

    def verdict(self, n: Node) -> str:
        """AND takes its worst part, OR its best."""
        if not n.parts:
            return self.leaf(n)
        return (max if n.kind == "and" else min)((self.verdict(p) for p in n.parts), key=VERDICTS.index)

    def judge(self, raw: str | None) -> tuple[str, list[str], str]:
        """(verdict, alternatives of an OR that are approved, explanation)."""
        _, tree = parse(raw, self.terms)
        if tree is None:
            return self.unknown, [], f"no licence expression: {self.unknown}"
        v = self.verdict(tree)
        branches = [p.text() for p in tree.parts if self.verdict(p) == "approved"] if tree.kind == "or" else []
        text = f"{v}: " + ", ".join(sorted(f"{x.text()} is {self.leaf(x)}" for x in tree.leaves()))
        if branches and len(branches) < len(tree.parts):
            text += "; only by choosing " + " or ".join(branches)
        return v, branches, text


def verdicts(rows: DataFrame, column: str, policy: Policy) -> DataFrame:
    """rows with verdict, acceptable (array) and explanation; each distinct expression is judged once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(raw, *policy.judge(raw)) for raw in b["_raw"]], columns=["_raw", "verdict", "acceptable", "explanation"])

    found = rows.select(F.col(column).alias("_raw")).distinct().mapInPandas(run, "_raw string, verdict string, acceptable array<string>, explanation string")
    return rows.join(found, rows[column].eqNullSafe(found["_raw"]), "left").drop("_raw")


def family(expression: Column) -> Column:
    """The strictest family among an expression's operands, in any case and with or without a plus; exceptions count for nothing."""
    table = F.create_map(*[F.lit(x) for fam, ids in FAMILY.items() for i in ids for x in (i.lower(), FAMILIES.index(fam))])
    flat = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(expression, F.lit(""))), r"[()]", " "), r"(^|\s)with\s+\S+", " ")
    operands = F.filter(F.split(F.trim(flat), r"\s+"), lambda t: ~t.isin("", "and", "or"))
    one = lambda t: F.when(t.isin("noassertion", "none"), F.lit(FAMILIES.index("unknown"))).otherwise(F.coalesce(F.try_element_at(table, t), F.try_element_at(table, F.regexp_replace(t, r"\+$", "")), F.lit(FAMILIES.index("other"))))
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, FAMILIES)), F.array_max(F.transform(operands, one)) + 1), F.lit("unknown"))
