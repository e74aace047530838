"""Byte-level BPE encoding and decoding as rounds of merges over padded numpy matrices."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pieces whose ids a task keeps from batch to batch; beyond it the task starts a new table.
CACHE_PIECES = 400_000
_NONE = np.int32(2**31 - 1)


class Ranks:
    """A rank file: token bytes by id, and a hash table from pairs of ids to the id of the merged token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            by_bytes = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens: dict[int, bytes] = {i: t for t, i in by_bytes.items()}
        self.n = max(self.tokens) + 1
        self.single = np.full(256, _NONE, dtype=np.int32)
        for b in range(256):
            self.single[b] = by_bytes.get(bytes([b]), _NONE)
        if (self.single == _NONE).any():
            raise ValueError("the rank file lacks single bytes")
        self.whole = by_bytes
        left, right, merged = [], [], []
        for t, i in by_bytes.items():
            for cut in range(1, len(t)):
                if (a := by_bytes.get(t[:cut])) is not None and (b := by_bytes.get(t[cut:])) is not None:
                    left.append(a), right.append(b), merged.append(i)
        keys = np.array(left, dtype=np.int64) * self.n + np.array(right, dtype=np.int64)
        size = 1 << max(4, int(4 * len(keys) - 1).bit_length())
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.full(size, _NONE, dtype=np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # open addressing: of those that want a free slot the last one written gets it
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]
            got = self.keys[at] == keys[todo]
            self.values[at[got]] = np.array(merged, dtype=np.int32)[todo[got]]
            todo, at = todo[~got], (at[~got] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each merged pair; the largest int32 where there is none."""
        shape = a.shape
        keys = (a.astype(np.int64) * self.n + b).ravel()
        at = self._slot(keys)
        out, found = np.full(len(keys), _NONE, dtype=np.int32), self.keys[at]
        hit = found == keys
        out[hit] = self.values[at[hit]]
        todo = np.flatnonzero(~hit & (found != -1))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            todo, at = todo[on], at[on]
        return out.reshape(shape)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece. Pieces of like length share a padded matrix; finished rows leave it."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.whole.get(p)) is not None:
                out[i] = np.array([whole], dtype=np.int32)
            else:
                buckets.setdefault(len(p) if len(p) <= 16 else 1 << (len(p) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 21) // width)
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                if width > 64:
                    for i in part:
                        out[i] = self._long(pieces[i])
                else:
                    self._matrix(pieces, part, width, out)
        return out

    def _matrix(self, pieces: list[bytes], rows: list[int], width: int, out: list) -> None:
        lens = np.array([len(pieces[i]) for i in rows])
        flat = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), dtype=np.uint8)
        ids = self.single[flat.reshape(len(rows), width)]
        at = np.arange(width)
        ranks = self.pair(ids[:, :-1], ids[:, 1:])
        ranks[at[:-1] >= (lens - 1)[:, None]] = _NONE
        own = np.array(rows)
        while len(own):
            spot = ranks.argmin(axis=1)  # the leftmost of the lowest rank
            low = ranks[np.arange(len(own)), spot]
            done = low == _NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[own[r]] = ids[r, : lens[r]].copy()
                on = ~done
                own, ids, ranks, lens, spot, low = own[on], ids[on], ranks[on], lens[on], spot[on], low[on]
                if not len(own):
                    break
            r = np.arange(len(own))
            ids[r, spot] = low
            # compaction: what lies right of the merged pair moves one place to the left
            w = ids.shape[1]
            gone = at[: w - 1] > spot[:, None]
            ids[:, : w - 1] = np.where(gone, ids[:, 1:], ids[:, : w - 1])
            ranks[:, : w - 2] = np.where(gone[:, : w - 2], ranks[:, 1:], ranks[:, : w - 2])
            lens = lens - 1
            ranks[r, np.minimum(lens - 1, w - 2)] = _NONE
            right = spot < lens - 1
            ranks[r[right], spot[right]] = self.pair(ids[r[right], spot[right]], ids[r[right], spot[right] + 1])
            ranks[r[~right], np.minimum(spot[~right], w - 2)] = _NONE
            left = spot > 0
            ranks[r[left], spot[left] - 1] = self.pair(ids[r[left], spot[left] - 1], ids[r[left], spot[left]])
            if (most := int(lens.max())) < w:
                ids, ranks = ids[:, :most].copy(), ranks[:, : most - 1].copy()
                if most < 2:
                    for i, row in zip(own, ids, strict=True):
                        out[i] = row.copy()
                    break

    def _long(self, piece: bytes) -> np.ndarray:
        """A matrix of one row. Places of the lowest pair merge together, from the left, up to the first merge that
        makes a pair of still lower rank, which would come before the places that follow."""
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)]
        while (n := len(ids)) > 1:
            ranks = self.pair(ids[:-1], ids[1:])
            low = ranks.min()
            if low == _NONE:
                break
            spots = np.flatnonzero(ranks == low)
            run = np.concatenate(([0], np.cumsum(np.diff(spots) > 1)))  # in a run of overlapping places every second one merges
            spots = spots[(np.arange(len(spots)) - np.searchsorted(run, run)) % 2 == 0]
            before = np.where(np.concatenate(([False], np.diff(spots) == 2)), low, ids[np.maximum(spots - 1, 0)])
            made = np.minimum(
                np.where(spots > 0, self.pair(before, np.full(len(spots), low)), _NONE),
                np.where(spots + 2 < n, self.pair(np.full(len(spots), low), ids[np.minimum(spots + 2, n - 1)]), _NONE),
            )
            lower = np.flatnonzero(made < low)
            spots = spots[: lower[0] + 1] if len(lower) else spots
            ids[spots] = low
            keep = np.ones(n, dtype=bool)
            keep[spots + 1] = False
            ids = ids[keep]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


class Encoder:
    """Encodes texts piece by piece; remembers the pieces it has met, up to a bound."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE_PIECES):
        self.ranks, self.split, self.cache = ranks(path), regex.compile(pattern).findall, cache
        self.known: dict[str, tuple[int, bytes, bytes]] = {}

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.cache:
            self.known.clear()
            new = list(pieces)
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        for p, ids in zip(new, self.ranks.merge(raw), strict=True):
            self.known[p] = (len(ids), b",".join(b"%d" % i for i in ids.tolist()), self.ranks.decode(ids))

    def encode(self, texts: list[str]) -> Iterator[list[tuple[int, bytes, bytes]]]:
        """Per text and piece: number of ids, the ids as decimal text, and the bytes that the ids stand for."""
        split = [self.split(t) for t in texts]
        pieces = set().union(*split)
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.cache:
            self.known.clear()
            new = list(pieces)
        ids = self.ranks.merge([p.encode("utf-8", "surrogatepass") for p in new])
        for p, x in zip(new, ids, strict=True):
            x = x.tolist()
            self.known[p] = (len(x), ",".join(map(str, x)).encode(), self.ranks.decode(x))
        for own in split:
            yield [self.known[p] for p in own]


def texts_of(column: pa.Array, size: int = 8 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about size characters, one text at least, with the row of the first; null as empty."""
    at, run, length = 0, [], 0
    for i, t in enumerate(column):
        t = t.as_py() or ""
        if run and length + len(t) > size:
            yield at, run
            at, run, length = i, [], 0
        run.append(t)
        length += len(t)
    if run:
        yield at, run


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) per row of docs: the ids of its whole text, null text as empty, no special tokens.

    path is the rank file, in a place that every executor can read; pattern splits a text into the pieces that merge
    separately. Row-local: nothing is shuffled. Very long texts are one row each; ids of an empty text are an empty
    array. Other columns of docs are ignored; null ids and repeated rows pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, pattern)
        for b in batches:
            for at, texts in texts_of(b.column(1)):
                rows = [[int(i) for p in parts for i in p[1].split(b",")] for parts in enc.encode(texts)]
                rows = pa.array(rows, type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), rows], names=[id_col, "ids"])

    src = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return src.mapInArrow(run, src.select(id_col, F.lit(None).cast("array<int>").alias("ids")).schema)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes binary) per row: the bytes that an array of ids stands for; null ids as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path).tokens
        for b in batches:
            out = [b"".join(map(table.__getitem__, ids or [])) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, type=pa.binary())], names=[id_col, "bytes"])

    src = encoded.select(F.col(id_col), F.col(ids_col).alias("_ids"))
    return src.mapInArrow(run, src.select(id_col, F.lit(None).cast("binary").alias("bytes")).schema)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode its ids, and return digests of both.

    (id_col, n_tokens long, ids_sha256, decoded_sha256, and ids with with_ids) per row: SHA-256 of the decimal ids
    joined by commas and of the decoded bytes. The same rules as bpe_encode; the decoded bytes don't leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, pattern)
        for b in batches:
            for at, texts in texts_of(b.column(1)):
                n, ids, back, lists = [], [], [], []
                for parts in enc.encode(texts):
                    n.append(sum(p[0] for p in parts))
                    flat = b",".join([p[1] for p in parts])
                    ids.append(hashlib.sha256(flat).hexdigest())
                    back.append(hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())
                    if with_ids:
                        lists.append(np.array(flat.split(b","), dtype=np.int32) if flat else np.zeros(0, dtype=np.int32))
                cols = [b.column(0).slice(at, len(texts)), pa.array(n, type=pa.int64()), pa.array(ids, type=pa.string()), pa.array(back, type=pa.string())]
                if with_ids:
                    cols.append(pa.array(lists, type=pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    none = F.lit(None).cast("string")
    out = [F.lit(None).cast("long").alias("n_tokens"), none.alias("ids_sha256"), none.alias("decoded_sha256")]
    out += [F.lit(None).cast("array<int>").alias("ids")] * with_ids
    schema = src.select(id_col, *out).schema
    names = schema.names
    return src.mapInArrow(run, schema)
