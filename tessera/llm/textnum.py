"""Words of many texts at once, as numpy arrays over the texts' UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_B = U(0x9E3779B97F4A7C15)
_INVERSE = pow(int(_B), -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that are runs of anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of words that are runs of lower-case ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: Powers of a base are a table of so many and, for what goes beyond it, powers of the next.
_STEP = 1 << 16


@lru_cache(maxsize=2)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base to 0, 1, ... _STEP - 1, and base ** _STEP to 0, 1, ... _STEP - 1: enough for texts of 4 GB."""
    out = []
    for b in (base, pow(base, _STEP, 1 << 64)):
        p = np.full(_STEP, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Words:
    """The words of some texts: start and end bytes, text number and 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.low = np.take(LOWER, data, mode="clip")
        self.offsets, self.n_docs = offsets, len(offsets) - 1
        mask = np.zeros(len(data) + 2, dtype=bool)
        np.take(inside, self.low, out=mask[1:-1], mode="clip")
        turns = np.flatnonzero(mask[1:] != mask[:-1])
        self.start, self.end = turns[::2], turns[1::2]
        inner = np.unique(offsets[1:-1])
        inner = inner[mask[inner] & mask[inner + 1]]  # texts that meet inside a run
        if len(inner):
            self.start = np.insert(self.start, np.searchsorted(self.start, inner), inner)
            self.end = np.insert(self.end, np.searchsorted(self.end, inner), inner)
        self.first_word = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first_word)
        self.doc = np.repeat(np.arange(self.n_docs, dtype=np.int32), self.counts)
        # bytes weigh by a power of their place; a span's sum divided by that of its start is the same wherever it is
        self._sum = np.zeros(len(data) + 1, dtype=np.uint64)
        part = self._sum[1:]
        np.take(_BYTE, self.low, out=part, mode="clip")
        low, high = _powers(int(_B))
        for i in range(0, len(data), _STEP):
            block = part[i : i + _STEP]
            block *= low[: len(block)]
            block *= high[i // _STEP]
        np.cumsum(part, dtype=np.uint64, out=part)
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of spans that begin where a word begins and end inside it or with it."""
        low, high = _powers(_INVERSE)
        return mix((self._sum[end] - self._sum[start]) * low[start % _STEP] * high[start // _STEP] + U(salt))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of k words within a text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        keep = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return keep, combine([self.hash[j : j + n][keep] for j in range(k)])


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """The hash of a run of words from the words' hashes, in order; its length is part of it."""
    h = np.full(len(parts[0]), len(parts), dtype=np.uint64)
    for p in parts:
        h = mix(h * _B + p)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return (np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, dtype=np.uint8)), offsets - lo


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = 4 << 20, rows: int = 60_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with about size bytes of text, at least one row each, with bytes and offsets of the text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
