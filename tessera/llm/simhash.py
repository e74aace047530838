"""SimHash near-dedup: fingerprints in a grid of bit counts, met within a Manhattan distance, verified by their bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, durable, key_join
from .textnum import LOWER, chunks
from .tiles import pairs, tiles

#: Differing bits of linked fingerprints, at most.
DISTANCE = 3
#: Shingles whose bits a task counts at once.
AT_ONCE = 1 << 16


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id long, fp long): the 64-bit SimHash of each row's text.

    A-Z are lower-cased; words are runs of anything but ASCII white space. Each run of `shingle` words, joined by single spaces and
    counted as often as it occurs (fewer words: the whole sequence), votes with the bits of its XXH64. A bit is 1 if over half of the
    votes have it. A text that is null or has no words gets 0.
    """
    low = bytes(LOWER)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in chunks(batches, "_text"):
            ones, votes = np.zeros((rows.num_rows, 64), dtype=np.int64), np.zeros(rows.num_rows, dtype=np.int64)
            held: list[int] = []
            owner: list[tuple[int, int]] = []

            def count() -> None:
                if not held:
                    return
                bits = np.unpackbits(np.array(held, dtype=">u8").view(np.uint8)).reshape(-1, 64)
                n = np.array([c for _, c in owner])
                np.add.at(ones, [r for r, _ in owner], np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64))
                held.clear(), owner.clear()

            for row, text in enumerate(rows.column("_text").to_pylist()):
                words = text.encode().translate(low).split() if text else []
                n = max(len(words) - shingle + 1, 1) if words else 0
                votes[row] = n
                for lo in range(0, n, AT_ONCE):
                    hi = min(lo + AT_ONCE, n)
                    held += [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in range(lo, hi)]
                    owner.append((row, hi - lo))
                    if len(held) >= AT_ONCE:
                        count()
            count()
            fp = np.packbits(2 * ones > votes[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("_id"), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(hashed, "id long, fp long")


def bit_counts(half: Column) -> Column:
    """Bit counts of the sixteen two-bit segments of a 32-bit half, each in the segment's own two bits."""
    return half - F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555))


def cells(fp: Column) -> Column:
    """The grid cells (key, own) in which a fingerprint meets others: its own one of each half, and those of one count more.

    Fingerprints that differ in at most 3 bits lie at a Manhattan distance of at most 3 in the grid of counts, so of at most 1 in one of
    the halves. There they have a cell in common that is the own one of at least one of them.
    """
    steps = F.array(*[F.lit(4**i).cast("long") for i in range(16)])

    def of_half(half: Column, no: int) -> Column:
        counts = bit_counts(half)
        key = counts.bitwiseOR(F.lit(no << 32))
        more = F.filter(steps, lambda s: counts.bitwiseAND(s * 2) == 0)
        return F.concat(F.array(F.struct(key.alias("key"), F.lit(True).alias("own"))), F.transform(more, lambda s: F.struct((key + s).alias("key"), F.lit(False).alias("own"))))

    return F.concat(of_half(fp.bitwiseAND(F.lit(0xFFFFFFFF)), 0), of_half(F.shiftrightunsigned(fp, 32), 1))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 edges between n places that connect what the edges (i, j) connect."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that connect what the links between the fingerprints of each tile connect."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            rows = batch.slice(lo, 4096)
            both = [rows.column("here"), rows.column("there")]
            sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in both]
            at = np.cumsum(sizes[0] + sizes[1]) - sizes[0] - sizes[1]
            place = [np.repeat(a, s) + np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s) for a, s in ((at, sizes[0]), (at + sizes[0], sizes[1]))]
            n = int(sizes[0].sum() + sizes[1].sum())
            ids, fp = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for c, p in zip(both, place, strict=True):
                flat = c.flatten()
                ids[p], fp[p] = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("id", "fp"))
            fp = fp.view(np.uint64)
            i = j = np.zeros(0, dtype=np.int64)
            for x, y in pairs(at, *sizes):
                near = np.bitwise_count(fp[x] ^ fp[y]) <= DISTANCE
                i, j = np.concatenate((i, x[near])), np.concatenate((j, y[near]))
                if len(i) > 2 * n:
                    i, j = forest(n, i, j)
            i, j = forest(n, i, j)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of docs: (id_col, fingerprint string of 16 hexadecimal digits, component_id).

    Fingerprints are those of `fingerprints`; two link if they differ in at most DISTANCE bits, and component_id is the smallest id reachable
    by links, the row's own included. Every link counts: texts without words have fingerprint 0, which links like any other.

    Equal fingerprints are one point. Points go to the cells of a grid of bit counts in which every linked pair meets (`cells`);
    within a cell they are compared bit by bit in tiles, and a tile gives only edges that connect what its links connect, so that
    a crowd of near copies gives no more rows than it has members in the cell.

    Rows with a null id get a fingerprint and a null component and link nothing. Rows repeated with one id are one node that has
    the links of each. An empty table gives an empty result; other columns are ignored.
    """
    prints = durable(fingerprints(docs, id_col, text_col, shingle))
    points = durable(prints.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id")))
    members = points.select("id", "fp", F.explode(cells(F.col("fp"))).alias("c")).select("c.key", "c.own", "id", "fp")
    met = tiles(members, F.struct("id", "fp", "own"))
    met = met.filter(F.exists("here", lambda x: x["own"]) | F.coalesce(F.exists("there", lambda x: x["own"]), F.lit(False)))
    links = met.mapInArrow(_links, "a long, b long")
    again = prints.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").select("id")
    same = prints.join(again, "id").select(F.col("id").alias("b"), "fp").join(points, "fp").select(F.col("id").alias("a"), "b")
    edges = durable(links.unionByName(same).distinct())
    label = components(points, edges)
    by_print = durable(points.join(label, "id").select("fp", "component"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    found = key_join(prints, by_print, "fp", "left")
    return found.select(F.col("id").alias(id_col), text.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))
