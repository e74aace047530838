"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, key_join


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: dict[str, Column] | None = None,
    prefix_chars: int = 64,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per row of docs: (id_col, keep_id, group_size, kept, and the columns of carry).

    Rows whose texts are identical form a group; the row with the largest id stays. A first pass reads lengths and
    hashes of a short prefix; only rows whose (length, prefix) recurs have their whole text hashed (SHA-256). Texts
    never cross a shuffle. carry names narrow expressions over the rows of docs that are worked out beside the hash.

    Null texts count as empty. Null ids count in group_size but never win against an id; a group of null ids alone
    keeps all its rows (keep_id null, kept true). Rows repeated with the same id are one document: all of them are
    kept or none. An empty table gives an empty result. Columns of docs other than the two named are ignored.
    """
    carry = carry or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), *[c.alias(k) for k, c in carry.items()])
    sized = {"_len": F.octet_length("_text"), "_prefix": F.xxhash64(F.substring("_text", 1, prefix_chars))}

    # lengths that recur, then (length, prefix) pairs that recur: rows are counted before they move
    narrow = durable(src.select(*[c.alias(k) for k, c in sized.items()]).groupBy("_len", "_prefix").agg(F.count("*").alias("_n")))
    lengths = narrow.groupBy("_len").agg(F.sum("_n").alias("_rows")).filter("_rows > 1").select("_len")
    recurring = durable(narrow.filter("_n > 1").join(lengths, "_len", "left_semi").select("_len", "_prefix", F.lit(True).alias("_again")))

    keyed = src.select("_id", "_text", *carry, *[c.alias(k) for k, c in sized.items()])
    if recurring.limit(broadcast_rows + 1).count() <= broadcast_rows:
        keyed = keyed.join(F.broadcast(recurring), ["_len", "_prefix"], "left")
        full = F.when(F.col("_again"), F.sha2("_text", 256))
        rows = keyed.select("_id", "_len", "_prefix", full.alias("_full"), *carry)
    else:  # too many keys to hold on each executor: hash where the text is read, then let narrow rows meet the keys
        rows = keyed.select("_id", "_len", "_prefix", F.sha2("_text", 256).alias("_hash"), *carry).join(recurring, ["_len", "_prefix"], "left")
        rows = rows.select("_id", "_len", "_prefix", F.when(F.col("_again"), F.col("_hash")).alias("_full"), *carry)
    rows = durable(rows)

    groups = (
        rows.filter("_full IS NOT NULL")
        .groupBy("_len", "_prefix", "_full")
        .agg(F.max("_id").alias("_keep"), F.count("*").alias("_size"))
        .filter("_size > 1")
    )
    out = key_join(rows, durable(groups), ["_len", "_prefix", "_full"], "left", broadcast_rows)
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        *carry,
    )
