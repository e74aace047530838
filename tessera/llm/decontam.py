"""Benchmark decontamination: a prefix-filtered set join between item windows and documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, written
from .textnum import ALNUM, Words, chunks, utf8

#: Bytes of benchmark text whose windows one pass over the documents holds: some 170 MB on the driver while it cuts them,
#: 12 MB for each Python worker.
BLOCK_BYTES = 1 << 20


class Windows:
    """The distinct windows of some items, each with the items that hold it, and all of its shingles."""

    def __init__(self, items: list[str], texts: pa.Array, window: int, shingle: int):
        w = Words(*utf8(texts), ALNUM)
        low = w.low.tobytes()
        seen: dict[tuple[bytes, ...], set[str]] = {}
        self.hashes: list[np.ndarray] = []
        first: dict[tuple[bytes, ...], int] = {}
        for d, item in enumerate(items):
            lo, hi = int(w.first_word[d]), int(w.first_word[d + 1])
            words = [low[a:b] for a, b in zip(w.start[lo:hi].tolist(), w.end[lo:hi].tolist(), strict=True)]
            size = min(window, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                key = tuple(words[at : at + size])
                seen.setdefault(key, set()).add(item)
                first.setdefault(key, lo + at)
        self.keys, self.items = list(seen), [sorted(x) for x in seen.values()]
        self.size = np.array([len(k) for k in self.keys], dtype=np.int64)
        self.k = np.minimum(self.size, shingle)
        of_k = {k: dict(zip(*w.shingles(k), strict=True)) for k in set(self.k.tolist())}
        #: hashes of the shingles of each window, in order
        self.shingles = [np.array([of_k[k][first[key] + j] for j in range(n - k + 1)], dtype=np.uint64) for key, n, k in zip(self.keys, self.size.tolist(), self.k.tolist(), strict=True)]

    def vocabulary(self) -> dict[int, np.ndarray]:
        return {int(k): np.unique(np.concatenate([s for s, own in zip(self.shingles, self.k, strict=True) if own == k])) for k in set(self.k.tolist())}

    def prefix(self, counts: dict[tuple[int, int], int]) -> None:
        """Of each window the rarest shingle, by its count in all documents: every text that holds the window holds it.

        Windows with a shingle that no document has are dropped: they occur nowhere.
        """
        rows = []
        for i, (s, k) in enumerate(zip(self.shingles, self.k.tolist(), strict=True)):
            n = [counts.get((k, int(h)), 0) for h in s]
            if min(n):
                j = min(range(len(n)), key=lambda x: (n[x], int(s[x])))
                rows.append((k, int(s[j]), j, i))
        self.by_k: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in {r[0] for r in rows}:
            own = sorted(r[1:] for r in rows if r[0] == k)
            self.by_k[k] = tuple(np.array([r[x] for r in own], dtype=t) for x, t in ((0, np.uint64), (1, np.int64), (2, np.int64)))  # type: ignore[assignment]

    def find(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """(first word, document, window) of each occurrence."""
        low = None
        for k, (keys, offset, window) in self.by_k.items():
            at, h = w.shingles(k)
            lo = np.searchsorted(keys, h)
            near = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == h)
            hi = np.searchsorted(keys, h[near], side="right")
            for i, a, b in zip(near.tolist(), lo[near].tolist(), hi.tolist(), strict=True):
                for j in range(a, b):  # windows that share this rarest shingle
                    win = int(window[j])
                    start, end = int(at[i] - offset[j]), int(at[i] - offset[j] + self.size[win])
                    doc = int(w.doc[at[i]])
                    if start < w.first_word[doc] or end > w.first_word[doc + 1]:
                        continue  # positional and length bounds
                    low = low or w.low.tobytes()
                    if all(low[w.start[x] : w.end[x]] == word for x, word in zip(range(start, end), self.keys[win], strict=True)):
                        yield start, doc, win


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 3,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Words of documents that lie in any occurrence of an item window: one row per row of docs.

    (id_col, n_words long, hits array<struct<start,end>> of word ranges, disjoint and in order, items array<string>
    sorted as strings). Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z; a window is
    `window` consecutive words of an item, or the whole item if it has fewer. Containment is a set join: the shingles
    of a window are ordered by their count in all documents, and a document meets a window only through the window's
    rarest shingle; position and length bounds and a comparison word by word follow.

    The benchmark is the query set: it is read in blocks of about block_bytes, so that what executors hold is bounded
    whatever its size; each block is one count and one search over the documents. Documents are never shuffled unless
    there are several blocks; then narrow results are grouped by row. Null and empty texts have no words; null or empty
    items have no windows; null item ids are ignored; repeated rows are reported each. Other columns are ignored.
    """
    bench, blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if blocks > 1:
        src = src.withColumn("_row", F.monotonically_increasing_id())
    else:
        src = src.withColumn("_row", F.lit(0).cast("long"))
    found = [_search(src, _counted(src, _windows(bench, b, blocks, window, shingle))) for b in range(blocks)]
    if blocks == 1:
        out = found[0]
    else:
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        every = every.groupBy("_row", "_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        join_up = F.expr(
            "aggregate(array_sort(hits), cast(array() as array<struct<start:bigint,end:bigint>>), (a, h) -> "
            "if(size(a) > 0 and element_at(a, -1).end >= h.start, concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, h.end)))), concat(a, array(h))))"
        )
        out = every.withColumn("hits", join_up)
    return out.select(F.col("_id").alias(id_col), "n_words", "hits", "items")


def without_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 3,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item window; the same join and rules as decontaminate.

    Each block of the benchmark filters what the blocks before it left and wrote, so that passes grow with the blocks;
    nothing is shuffled. Null and empty texts, null ids and repeated rows are judged like others; an empty table or
    benchmark gives docs back; no column's name matters.
    """
    bench, blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    for b in range(blocks):
        src = beside(docs, text_col)
        ready = _counted(src.select(F.col("text").alias("_text")), _windows(bench, b, blocks, window, shingle))

        def run(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
            for rows, data, offsets in chunks(batches, "text"):
                hit = {doc for _, doc, _ in ready.value.find(Words(data, offsets, ALNUM))}
                keep = pa.array([d for d in range(rows.num_rows) if d not in hit], type=pa.int64())
                if len(keep):
                    yield pa.RecordBatch.from_struct_array(rows.column("row").take(keep))

        docs = src.mapInArrow(run, docs.schema)
        if b + 1 < blocks:
            docs = written(docs)
    return docs


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    bench = benchmark.select(F.col(item_col).cast("string").alias("_item"), F.col(item_text_col).alias("_text")).filter("_item IS NOT NULL AND _text IS NOT NULL")
    total = bench.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    return bench, max(1, -(-total // block_bytes))


def _windows(bench: DataFrame, no: int, blocks: int, window: int, shingle: int) -> Windows:
    part = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == no)
    table = part.toArrow()
    return Windows(table.column(0).to_pylist(), table.column(1), window, shingle)


def _counted(src: DataFrame, windows: Windows) -> Broadcast:
    """The windows, broadcast with the rarest shingle of each as its prefix; counts are over all rows of src."""
    spark = src.sparkSession
    vocabulary = windows.vocabulary() if windows.keys else {}
    shared = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(len(v), dtype=np.int64) for k, v in shared.value.items()}
        for _, data, offsets in chunks(batches, "_text"):
            w = Words(data, offsets, ALNUM)
            for k, vocab in shared.value.items():
                _, h = w.shingles(k)
                at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                sums[k] += np.bincount(at[vocab[at] == h], minlength=len(vocab))
        for k, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, dtype=np.int32)), pa.array(shared.value[k][some].view(np.int64)), pa.array(n[some])], names=["k", "h", "n"])

    counts: dict[tuple[int, int], int] = {}
    if vocabulary:
        rows = src.select("_text").mapInArrow(count, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the block has shingles
        counts = {(k, h & (2**64 - 1)): n for k, h, n in zip(*(c.to_pylist() for c in rows.columns), strict=True)}
    windows.prefix(counts)
    windows.shingles = []
    return spark.sparkContext.broadcast(windows)


def _search(src: DataFrame, ready: Broadcast) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wins = ready.value
        spans_of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for rows, data, offsets in chunks(batches, "_text"):
            w = Words(data, offsets, ALNUM)
            hits: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for start, doc, win in wins.find(w):
                start -= int(w.first_word[doc])
                hits.setdefault(doc, []).append((start, start + int(wins.size[win])))
                items.setdefault(doc, set()).update(wins.items[win])
            spans = []
            for d in range(rows.num_rows):
                own: list[dict[str, int]] = []
                for a, b in sorted(hits.get(d, ())):
                    if own and a <= own[-1]["end"]:
                        own[-1]["end"] = max(b, own[-1]["end"])
                    else:
                        own.append({"start": a, "end": b})
                spans.append(own)
            names = [sorted(items.get(d, ())) for d in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id"), rows.column("_row"), pa.array(w.counts), pa.array(spans, type=spans_of), pa.array(names, type=pa.list_(pa.string()))],
                names=["_id", "_row", "n_words", "hits", "items"],
            )

    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(search, f"_id {kind}, _row long, n_words long, hits array<struct<start:long,end:long>>, items array<string>")
