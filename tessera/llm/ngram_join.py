"""N-gram Jaccard join: near duplicates by a grouped prefix join over word shingles.

1. Every text becomes its set of distinct shingles. Sets meet by shingle in packed blocks (one block for each pair of
   a text chunk and a hash range), which gives each shingle's document count. A shingle of one document joins nothing:
   only shared shingles travel on, and a set with fewer than ceil(t * n) of them has no partner at all.
2. In the order (count, hash) the first n - ceil(t * n) + 1 shingles of a set are its prefix: two sets that link share
   one. Equal sets collapse to one class, classes with the same size and prefix to one group.
3. Groups first link to the first group of each prefix shingle, members to the first of their group: a star, not all
   pairs. Group pairs that still lie in different components of the verified links go through length and positional
   filters, are expanded to members, and are all verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, linked
from .textnum import NOT_SPACE, U, Words, chunks, combine, mix

#: A shingle in this many texts of one chunk sends a count to its hash range; the texts' list goes round it.
HEAVY = 16
_SETS, _LISTS, _COUNTS = 1, 2, 3
#: Text whose shingles one hash range takes: about as many bytes again as packed blocks.
RANGE_BYTES = 64 << 20
#: Classes with so many bytes of shared shingles in all are broadcast to the pairs that are verified.
BROADCAST_BYTES = 32 << 20


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, by text and hash. A text of fewer than k words has one, of all of them."""
    first, h = w.shingles(k)
    doc = w.doc[first]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        more = np.zeros(len(short), dtype=np.uint64)
        for n in range(1, k):
            own = np.flatnonzero(w.counts[short] == n)
            at = w.first_word[short[own]]
            more[own] = combine([w.hash[at + j] for j in range(n)])
        doc, h = np.concatenate((doc, short.astype(doc.dtype))), np.concatenate((h, more))
    by = np.argsort(h)
    by = by[np.argsort(doc[by].astype(np.uint16) if w.n_docs < 65536 else doc[by], kind="stable")]
    doc, h = doc[by], h[by]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, dtype=np.int64)
    return start, np.diff(np.append(start, len(x)))


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.int64(len(arrays[0])).tobytes(), *(a.tobytes() for a in arrays)])


def _unpack(blob: bytes, *dtypes: type) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for t in dtypes:
        out.append(np.frombuffer(blob, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: (id_col, n_shingles long, component_id).

    Words are runs of anything but ASCII white space, after lower-casing A-Z. A text's set is its distinct runs of
    `shingle` words; a text of fewer words has one, the whole sequence; a null or empty text has none and links with
    nothing. Two texts link when 100 * intersection >= percent * union, and component_id is the smallest id reachable
    by links, the text's own included. Every link between different sets is found or implied by other links of its
    component. Equal sets are found by 128 bits of hashes, shared shingles of two texts by 38 bits or more: hash ranges,
    whose number counts in, grow with the bytes of text, so that each stays within a task's memory.

    Rows with a null id count like others but get a null component and link nothing. Rows repeated with one id are
    one node that has the links of each. An empty table gives an empty result; other columns are ignored.

    docs must give the same rows in the same partitions when read again (a table or files do).
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_BYTES)
    bits = min(24, max(6, int(ranges - 1).bit_length()))
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for no, (rows, data, offsets) in enumerate(chunks(batches, "_text")):
            doc, h = shingle_sets(Words(data, offsets, NOT_SPACE), shingle)
            n = np.bincount(doc, minlength=rows.num_rows).astype(np.int64)
            chunk = (part << 32) | no
            start, _ = _runs(doc)
            key = [np.zeros(rows.num_rows, dtype=np.uint64), np.zeros(rows.num_rows, dtype=np.uint64)]
            if len(start):
                key[0][doc[start]] = np.add.reduceat(mix(h), start)
                key[1][doc[start]] = np.add.reduceat(mix(h ^ U(0x5851F42D4C957F2D)), start)
            ids = rows.column("_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            valid = rows.column("_id").is_valid().to_numpy(zero_copy_only=False).astype(np.int8)
            # what concerns the chunk as a whole goes to a range picked by the chunk
            to = int(mix(np.array([chunk], dtype=np.uint64))[0] >> U(64 - bits))
            out = [(to, chunk, _SETS, _pack(ids, valid, n, *key))]
            by = np.argsort(h, kind="stable")
            h, doc = h[by], doc[by].astype(np.uint16)
            reach, token = (h >> U(64 - bits)).astype(np.int32), ((h >> U(32 - bits)) & U(0xFFFFFFFF)).astype(np.uint32)
            whole = h >> U(32 - bits)
            begin, length = _runs(whole)
            many = length >= HEAVY
            heavy = np.repeat(many, length)
            if many.any():
                out.append((to, chunk, _LISTS, _pack(whole[heavy], doc[heavy])))
            hot, hot_n = whole[begin[many]], length[many].astype(np.uint32)
            reach, token, doc = reach[~heavy], token[~heavy], doc[~heavy]
            ends, hot_ends = np.searchsorted(reach, np.arange((1 << bits) + 1)), np.searchsorted(hot >> U(32), np.arange((1 << bits) + 1, dtype=np.uint64))
            for r in np.flatnonzero((np.diff(ends) > 0) | (np.diff(hot_ends) > 0)).tolist():
                a, b, c, d = int(ends[r]), int(ends[r + 1]), int(hot_ends[r]), int(hot_ends[r + 1])
                out.append((r, chunk, 0, _pack(token[a:b], doc[a:b]) + _pack((hot[c:d] & U(0xFFFFFFFF)).astype(np.uint32), hot_n[c:d])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[j] for o in out], type=t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int8(), pa.binary()))],
                names=["reach", "chunk", "kind", "blob"],
            )

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Document counts of one hash range; what is shared goes back to its chunk."""
        out, own = [], pdf[pdf["kind"] == 0]
        for chunk, kind, blob in zip(pdf["chunk"], pdf["kind"], pdf["blob"], strict=True):
            if kind:
                out.append((chunk, kind, -1, blob))
        tokens, texts, hot, hot_n = [], [], [], []
        for blob in own["blob"]:
            t, d = _unpack(blob, np.uint32, np.uint16)
            x, n = _unpack(blob[8 + 6 * len(t) :], np.uint32, np.uint32)
            tokens.append(t), texts.append(d), hot.append(x), hot_n.append(n)
        if tokens:
            owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            hot_owner = np.repeat(np.arange(len(hot)), [len(x) for x in hot])
            t, d = np.concatenate(tokens), np.concatenate(texts)
            x, n = np.concatenate(hot), np.concatenate(hot_n).astype(np.int64)
            both = np.concatenate((t, x))
            value, back = np.unique(both, return_inverse=True)
            df = np.bincount(back, weights=np.concatenate((np.ones(len(t)), n)), minlength=len(value)).astype(np.int64)
            df = np.minimum(df[back], 2**31 - 1).astype(np.uint32)
            for kind, keep, o, cols in ((0, df[: len(t)] > 1, owner, (t, d)), (_COUNTS, np.ones(len(x), dtype=bool), hot_owner, (x,))):
                o, count_ = o[keep], (df[: len(t)] if kind == 0 else df[len(t) :])[keep]
                cols = [c[keep] for c in cols]
                start, length = _runs(o)
                for s, ln in zip(start.tolist(), length.tolist(), strict=True):
                    out.append((own["chunk"].iloc[int(o[s])], kind, key[0], _pack(*(c[s : s + ln] for c in cols), count_[s : s + ln])))
        return pd.DataFrame(out, columns=["chunk", "kind", "reach", "blob"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        """The sets of one chunk, with prefix and shared shingles where they can have a partner."""
        token, text, df = [], [], []
        lists, counts = [], []
        ids = None
        for kind, reach, blob in zip(pdf["kind"], pdf["reach"], pdf["blob"], strict=True):
            if kind == _SETS:
                ids, valid, n, k1, k2 = _unpack(blob, np.int64, np.int8, np.int64, np.int64, np.int64)
            elif kind == _LISTS:
                lists.append(_unpack(blob, np.uint64, np.uint16))
            elif kind == _COUNTS:
                t, c = _unpack(blob, np.uint32, np.uint32)
                counts.append(((np.uint64(reach) << U(32)) | t.astype(np.uint64), c))
            else:
                t, d, c = _unpack(blob, np.uint32, np.uint16, np.uint32)
                token.append((np.uint64(reach) << U(32)) | t.astype(np.uint64)), text.append(d), df.append(c)
        if lists:
            value, c = (np.concatenate(x) for x in zip(*counts, strict=True))
            by = np.argsort(value)
            value, c = value[by], c[by]
            for t, d in lists:
                token.append(t), text.append(d), df.append(c[np.searchsorted(value, t)])
        rows = len(ids)
        prefix, shared = [None] * rows, [None] * rows
        if token:
            token, text, df = np.concatenate(token), np.concatenate(text), np.concatenate(df)
            by = np.lexsort((token, df, text))
            token, text = token[by], text[by]
            start, length = _runs(text)
            for s, ln in zip(start.tolist(), length.tolist(), strict=True):
                d, size = int(text[s]), int(n[text[s]])
                need = -(-percent * size // 100)
                if ln >= need and valid[d]:
                    own = token[s : s + ln]
                    prefix[d] = own[: ln - need + 1].astype(np.int64)
                    shared[d] = np.unique(own).tobytes()
        return pd.DataFrame({"id": pd.Series(ids).astype("Int64").mask(valid == 0), "n": n, "k1": k1, "k2": k2, "prefix": prefix, "shared": shared})

    blocks = src.mapInArrow(scan, "reach int, chunk long, kind byte, blob binary")
    counted = blocks.groupBy("reach").applyInPandas(count, "chunk long, kind byte, reach int, blob binary")
    sets = durable(counted.groupBy("chunk").applyInPandas(gather, "id long, n long, k1 long, k2 long, prefix array<long>, shared binary"))

    # equal sets are one class, named by its smallest id
    some = sets.filter("shared IS NOT NULL")
    classes = durable(
        some.groupBy("n", "k1", "k2").agg(F.min("id").alias("id"), F.min_by("prefix", "id").alias("prefix"), F.min_by("shared", "id").alias("shared"))
    )
    grouped = classes.groupBy("n", "prefix").agg(F.min("id").alias("gid"))
    classes_of = classes.select("id", "n", "k1", "k2", "prefix").join(grouped, ["n", "prefix"]).select("id", "n", "k1", "k2", "prefix", "gid")
    members = durable(classes_of.select(F.col("gid").alias("unit"), "id"))

    # groups meet by prefix shingle; `left` shared shingles, this one counted, follow in a set's order
    shared_n = F.size("prefix") - 1 + F.ceil(F.col("n") * percent / 100)
    posts = grouped.select(F.col("gid").alias("unit"), "n", shared_n.alias("_s"), F.posexplode("prefix").alias("pos", "token"))
    posts = durable(posts.select("token", "unit", "n", (F.col("_s") - F.col("pos")).alias("left")))
    # length and positional bounds: at the first shingle that two prefixes share, no more than `left` can be common
    near = (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (F.least("left", "left2") * (100 + percent) >= (F.col("n") + F.col("n2")) * percent)
    size = classes.agg(F.sum(F.octet_length("shared") + 64).alias("n")).first()["n"] or 0
    final = linked(posts, members, lambda pairs: _verified(pairs, classes, percent, size <= BROADCAST_BYTES), near)

    by_set = durable(classes_of.join(final, "id").select("n", "k1", "k2", "component"))
    own = sets.select("id", "n", "k1", "k2", F.col("shared").isNotNull().alias("_some"))
    out = own.join(by_set.withColumn("_some", F.lit(True)), ["n", "k1", "k2", "_some"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def _verified(pairs: DataFrame, classes: DataFrame, percent: int, small: bool) -> DataFrame:
    """The pairs (a, b) of classes whose sets link. A set's shared shingles hold every intersection it has.

    Where all classes together are small they are broadcast to the pairs; else pairs and classes are shuffled.
    """
    hint = F.broadcast if small else lambda df: df
    of = lambda x: hint(classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"s_{x}")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (na, nb, sa, sb) in enumerate(zip(*(b.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")), strict=True)):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (na + nb - both):
                    keep.append(i)
            if keep:
                yield b.select(["a", "b"]).take(pa.array(keep))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(check, "a long, b long")
