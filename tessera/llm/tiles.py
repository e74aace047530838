"""Members of a key compared with each other, in tiles of bounded size: no list of a whole key, no pair as a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, key_join

#: Members of one block.
BLOCK = 1024
#: Pairs that a task holds at once.
PAIRS = 1 << 19


def tiles(members: DataFrame, item: Column, block: int = BLOCK) -> DataFrame:
    """(key, here array, there array or null): every pair of different items of a key lies in exactly one row.

    members has a column key and no item twice for one key. Where there is null, the pairs are those within here, else those of
    one in here and one in there. A key of more than `block` members is dealt into blocks by hash; its blocks meet each
    other as rows of a join, so that no task or row holds the whole key. Keys of one member are left out.
    """
    sizes = members.groupBy("key").count()
    large = durable(sizes.filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).alias("blocks")))
    rows = members.select("key", item.alias("item"))
    if large.isEmpty():
        return rows.groupBy("key").agg(F.collect_list("item").alias("here")).filter(F.size("here") > 1).withColumn("there", F.lit(None).cast(f"array<{rows.schema['item'].dataType.simpleString()}>"))
    rows = key_join(rows, large, "key", "left")
    dealt = rows.groupBy("key", "blocks", F.pmod(F.xxhash64("item"), F.coalesce("blocks", F.lit(1))).alias("no")).agg(F.collect_list("item").alias("here"))
    dealt = durable(dealt.filter(F.col("blocks").isNotNull() | (F.size("here") > 1)))
    within = dealt.filter(F.size("here") > 1).select("key", "here", F.lit(None).cast(dealt.schema["here"].dataType).alias("there"))
    cut = dealt.filter("blocks IS NOT NULL")
    across = cut.select("key", "no", "here").join(cut.select("key", F.col("no").alias("other"), F.col("here").alias("there")), "key").filter("no < other")
    return within.unionByName(across.select("key", "here", "there"))


def pairs(at: np.ndarray, here: np.ndarray, there: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs of tiles, some PAIRS at a time.

    Tile t holds `here[t]` places from at[t] on and then `there[t]` places; there[t] is 0 where pairs lie within.
    """
    # one line for each place of `here`: it meets the places after it, or all of `there`
    tile = np.repeat(np.arange(len(at)), here)
    rank = np.arange(len(tile)) - np.repeat(np.cumsum(here) - here, here)
    own, across = at[tile] + rank, there[tile] > 0
    first = np.where(across, at[tile] + here[tile], own + 1)
    n = np.where(across, there[tile], here[tile] - rank - 1)
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        base = int(ends[lo - 1]) if lo else 0
        hi = max(int(np.searchsorted(ends, base + PAIRS, side="right")), lo + 1)
        m = n[lo:hi]
        step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(own[lo:hi], m), np.repeat(first[lo:hi], m) + step
        lo = hi
