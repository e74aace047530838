"""Quality by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import beside
from .labelled import sample, sampled_docs
from .textnum import ALNUM, NOT_SPACE, U, Words, chunks, mix

#: Terms are hashed to so many columns; the latent space has DIMS dimensions.
COLUMNS = 8192
DIMS = 48
#: Labelled documents whose vectors every executor holds: 6,000 * 48 floats, about 1 MB.
NEIGHBOURS = 6_000
#: Rows of documents times labelled rows in one block of cosine products.
BLOCK = 1024
#: Whole steps of one in a latent vector, and in the factors of its projection.
UNIT, EXACT = 1 << 10, 1 << 20

_LETTER = np.zeros(256, dtype=np.uint8)  # 1 lower or non-ASCII letter, 2 upper, 3 digit, 4 sign
_LETTER[:] = 4
_LETTER[97:123] = _LETTER[128:] = 1
_LETTER[65:91] = 2
_LETTER[48:58] = 3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, column, count): words, the shapes and the signs of space-separated tokens, repeated tokens and lines.

    A text's style is what sets junk apart from prose, so tokens of any content count by shape too: lower, capitalised,
    upper, mixed with digits or signs; which signs end them; whether they have been seen before in the text.
    """
    words = Words(data, offsets, ALNUM)
    tokens = Words(data, offsets, NOT_SPACE)
    kind = _LETTER[data]
    some = [np.concatenate(([0], np.cumsum(kind == k))) for k in (1, 2, 3, 4)]
    n = [c[tokens.end] - c[tokens.start] for c in some]
    size = tokens.end - tokens.start
    shape = (n[0] > 0) + 2 * (n[1] > 0) + 4 * (n[1] > 1) + 8 * (n[2] > 0) + 16 * np.minimum(n[3], 4) + 128 * np.minimum(size // 4, 6)
    last = data[tokens.end - 1].astype(np.int64) if len(size) else np.zeros(0, dtype=np.int64)
    last[kind[tokens.end - 1] != 4] = 0
    key = np.stack([tokens.doc.astype(np.uint64), tokens.hash]) if len(size) else np.zeros((2, 0), dtype=np.uint64)
    by = np.lexsort((np.arange(len(size)), key[1], key[0]))
    again = np.zeros(len(size), dtype=np.int64)
    same = (key[0][by][1:] == key[0][by][:-1]) & (key[1][by][1:] == key[1][by][:-1])
    again[by[1:][same]] = 1
    salted = [
        (words.doc, words.hash),
        (tokens.doc, mix(shape.astype(np.uint64) + U(1 << 40))),
        (tokens.doc, mix(last.astype(np.uint64) + U(1 << 41))),
        (tokens.doc, mix(again.astype(np.uint64) + U(1 << 42) + (size > 3).astype(np.uint64) * U(2))),
    ]
    doc = np.concatenate([d for d, _ in salted]).astype(np.int64)
    col = np.concatenate([h for _, h in salted]) % U(COLUMNS)
    flat, count = np.unique(doc * COLUMNS + col.astype(np.int64), return_counts=True)
    return flat // COLUMNS, flat % COLUMNS, count


class NeighbourVote:
    """Latent vectors of labelled texts and their labels."""

    def __init__(self, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, base: float, k: int, power: float):
        self.basis, self.vectors, self.labels, self.base, self.k, self.power = basis, vectors, labels, base, k, power

    def latent(self, n: int, doc: np.ndarray, col: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Unit vectors: log counts, normalised, weighted and projected. A text without terms has the null vector.

        Factors of both products are whole multiples of small powers of two, whose sums are exact in any order: equal
        texts have equal vectors and cosines wherever they stand.
        """
        value = 1 + np.log(count)
        norm = np.sqrt(np.bincount(doc, weights=value**2, minlength=n))
        out = np.zeros((n, self.basis.shape[1]))
        for lo in range(0, n, 256):
            a, b = np.searchsorted(doc, (lo, lo + 256))
            block = np.zeros((min(256, n - lo), COLUMNS))
            block[doc[a:b] - lo, col[a:b]] = np.round(value[a:b] / norm[doc[a:b]] * EXACT)
            out[lo : lo + 256] = block @ self.basis
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.round(out / np.maximum(length, 1e-12) * UNIT).astype(np.float32)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Exact cosines with every labelled vector, block by block; the k nearest vote with sim ** power.

        Of equally near ones those with the smaller label id, which come first among the vectors, vote.
        """
        if not len(self.labels):
            return np.full(len(x), self.base)
        out, k = np.empty(len(x)), min(self.k, len(self.labels))
        for lo in range(0, len(x), BLOCK):
            part = x[lo : lo + BLOCK]
            best = np.full((len(part), k), -(1 << 62))
            for at in range(0, len(self.labels), BLOCK):
                s = (part @ self.vectors[at : at + BLOCK].T).astype(np.int64)
                s = s * len(self.labels) - np.arange(at, at + s.shape[1])  # no two are equal
                s = np.concatenate((best, s), axis=1)
                best = -np.partition(-s, k - 1, axis=1)[:, :k]
            best = -np.sort(-best, axis=1)
            sim = -(-best // len(self.labels))
            own = self.labels[sim * len(self.labels) - best]
            weight = np.maximum(sim / UNIT**2, 0) ** self.power
            # one vote of small weight for the base rate decides where there are no neighbours
            out[lo : lo + BLOCK] = ((weight * own).sum(axis=1) + 1e-3 * self.base) / (weight.sum(axis=1) + 1e-3)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "quality", rows: int = NEIGHBOURS, dims: int = DIMS, k: int = 15, power: float = 16.0, seed: int = 3) -> NeighbourVote:
    """Latent-semantic vectors of at most `rows` labelled documents outside the held-out fold.

    Executors count hashed terms of the sampled texts; a randomised singular value decomposition of the weighted
    matrix of at most rows x COLUMNS gives the basis. Terms weigh the more the rarer they are in the sample. Null and
    empty texts have the null vector; rows repeated with one id count each. Without labelled documents every score is 0.5.
    """
    known = sampled_docs(docs, sample(labels, target, id_col, rows), id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, "_text"):
            d, c, n = features(data, offsets)
            cut = pa.array(np.searchsorted(d, np.arange(part.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_y"), pa.ListArray.from_arrays(cut, pa.array(c.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(n.astype(np.int32)))],
                names=["id", "y", "c", "n"],
            )

    kind = known.schema["_id"].dataType.simpleString()
    table = known.select("_id", "_text", "_y").mapInArrow(count, f"id {kind}, y int, c array<int>, n array<int>").toArrow().sort_by("id")
    y = table.column("y").to_numpy().astype(np.float32) if table.num_rows else np.zeros(0, dtype=np.float32)
    if not len(y):
        return NeighbourVote(np.zeros((COLUMNS, 1)), np.zeros((0, 1), dtype=np.float32), y, 0.5, k, power)
    lists = table.column("c").combine_chunks()
    doc = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
    col, n = lists.flatten().to_numpy(), table.column("n").combine_chunks().flatten().to_numpy()
    idf = np.log((1 + len(y)) / (1 + np.bincount(col, minlength=COLUMNS))).astype(np.float32) + 0.1
    value = 1 + np.log(n)
    norm = np.sqrt(np.bincount(doc, weights=value**2, minlength=len(y)))
    m = np.zeros((len(y), COLUMNS), dtype=np.float32)
    m[doc, col] = value / norm[doc] * idf[col]
    rng = np.random.default_rng(seed)
    q = m.T @ rng.standard_normal((len(y), dims + 10)).astype(np.float32)
    for _ in range(4):
        q, _r = np.linalg.qr(m.T @ (m @ q))
    _, sv, vt = np.linalg.svd(m @ q, full_matrices=False)
    basis = np.round(idf[:, None] * (q @ vt.T[:, :dims]) * EXACT).astype(np.float64)
    model = NeighbourVote(basis, np.zeros((0, dims), dtype=np.float32), y, float(y.mean()), k, power)
    model.vectors = model.latent(len(y), doc, col, n)
    return model


def score(docs: DataFrame, model: NeighbourVote, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column `name`: the similarity-weighted share of good neighbours of the whole text.

    Null and empty texts have no vector and get the base rate of the sample, as does everything where no label is
    known. Equal texts get equal scores. Null ids pass through; an empty table gives an empty one. A column that is called
    `name` already is replaced; no other name matters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, data, offsets in chunks(batches, "text"):
            y = m.vote(m.latent(part.num_rows, *features(data, offsets)))
            cols = dict(zip(docs_columns, part.column("row").flatten(), strict=True))
            yield pa.RecordBatch.from_arrays([*(cols[c] for c in kept), pa.array(y)], names=[*kept, name])

    docs_columns = docs.columns
    return beside(docs, text_col).mapInArrow(run, StructType([*[docs.schema[c] for c in kept], StructField(name, DoubleType())]))
