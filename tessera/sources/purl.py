"""Package URLs as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Package types and the managers that serve them.
MANAGERS = {"golang": "gomod", "npm": "npm", "maven": "maven", "pypi": "pip", "cargo": "cargo", "nuget": "nuget", "gem": "gem"}


def parse_purl(purl: Column) -> Column:
    """struct(type, namespace, name, version, qualifiers map) of a package URL; null where it isn't one.

    The scheme has no case; a subpath is left out; the version is what stands behind the last @. Segments, version and qualifier values are
    decoded (+ is a space in values alone); one that can't be decoded, an empty name or namespace segment or an empty qualifier key
    makes the whole value null. Keys are in lower case, and the last of equal ones counts. What isn't there is null.
    """
    cut = lambda text, p: F.regexp_extract(text, p, 1)
    decode = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    rest = F.substring_index(cut(purl, "(?s)^[^:]*:/*(.*)$"), "#", 1)
    path = F.substring_index(rest, "?", 1)
    told = cut(path, "(?s)^[^/]*/(.*)$")
    versioned = F.contains(told, F.lit("@"))
    version = F.when(versioned, decode(F.substring_index(told, "@", -1))).otherwise("")
    named = F.regexp_replace(F.when(versioned, cut(told, "(?s)^(.*)@[^@]*$")).otherwise(told), "^/+|/+$", "")
    segments = F.transform(F.split(named, "/", -1), decode)
    pairs = F.split(cut(rest, r"(?s)^[^?]*\?(.*)$"), "&", -1)
    entries = F.transform(pairs, lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("key"), F.try_url_decode(cut(p, "(?s)^[^=]*=(.*)$")).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    asked = F.contains(rest, F.lit("?")) & (cut(rest, r"(?s)^[^?]*\?(.*)$") != "")
    sound = (
        (F.lower(F.substring_index(purl, ":", 1)) == "pkg") & F.contains(purl, F.lit(":")) & F.contains(path, F.lit("/")) & (F.substring_index(path, "/", 1) != "") & version.isNotNull()
        & F.forall(segments, lambda s: s.isNotNull() & (s != "")) & (~asked | F.forall(entries, lambda e: (e["key"] != "") & e["value"].isNotNull()))
    )
    none = F.lit("")
    return F.when(
        sound,
        F.struct(
            F.lower(F.substring_index(path, "/", 1)).alias("type"), F.nullif(F.array_join(F.slice(segments, F.lit(1), F.size(segments) - 1), "/"), none).alias("namespace"), F.element_at(segments, -1).alias("name"),
            F.nullif(version, none).alias("version"), F.when(asked, F.map_from_entries(last)).alias("qualifiers"),
        ),
    )


def strict_purl(purl: Column) -> Column:
    """struct(manager, name, version) of a plain package URL: a known type, name and version, no qualifiers or subpath; else null."""
    p = r"^pkg:([^/?#]+)/([^?#]*[^@?#])@([^@?#]+)$"
    part = lambda i: F.regexp_extract(purl, p, i)
    decode = lambda c: F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    manager = F.try_element_at(F.create_map(*[F.lit(x) for kv in MANAGERS.items() for x in kv]), F.lower(part(1)))
    return F.when(purl.rlike(p) & manager.isNotNull() & decode(part(2)).isNotNull() & decode(part(3)).isNotNull(), F.struct(manager.alias("manager"), decode(part(2)).alias("name"), decode(part(3)).alias("version")))
