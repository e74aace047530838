"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import beside, durable
from .labelled import SAMPLE_ROWS, sample, sampled_docs
from .textnum import ALNUM, U, Words, chunks, mix, utf8

#: Terms are hashed to this many bits; the terms that tell most stay in the model.
BITS = 22
TERMS = 4096
#: Beginnings of a word (in UTF-8 bytes) that are terms beside the word itself.
STEMS = (4, 5, 6, 8)


def terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) pairs, each once: words, beginnings of words and neighbouring words, hashed."""
    doc, h = [w.doc], [w.hash]
    size = w.end - w.start
    for k in STEMS:
        own = np.flatnonzero(size > k)
        doc.append(w.doc[own]), h.append(w.span_hash(w.start[own], w.start[own] + k, salt=k))
    first, two = w.shingles(2)
    doc.append(w.doc[first]), h.append(two)
    key = (np.concatenate(doc).astype(np.uint64) << U(BITS)) | (mix(np.concatenate(h)) >> U(64 - BITS))
    key.sort()
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return (key >> U(BITS)).astype(np.int64), (key & U((1 << BITS) - 1)).astype(np.int64)


class FactorizationMachine:
    """score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the model's terms that a text has."""

    def __init__(self, slots: np.ndarray, factors: int, seed: int = 7):
        self.slots = slots  # sorted hashed terms
        n = len(slots)
        self.b, self.w = 0.0, np.zeros(n, dtype=np.float64)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (n, factors))

    def rows(self, n: int, doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.slots, term), max(len(self.slots) - 1, 0))
        keep = self.slots[at] == term if len(self.slots) else np.zeros(len(term), dtype=bool)
        return doc[keep], at[keep]

    def margin(self, n: int, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.stack([np.bincount(doc, weights=self.v[at, f], minlength=n) for f in range(self.v.shape[1])], axis=1)
        q = np.bincount(doc, weights=(self.v[at] ** 2).sum(axis=1), minlength=n)
        return self.b + np.bincount(doc, weights=self.w[at], minlength=n) + 0.5 * ((s**2).sum(axis=1) - q), s

    def score(self, n: int, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(n, *self.rows(n, doc, term))[0], -35, 35)))

    def fit(self, n: int, doc: np.ndarray, term: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.05, l2: float = 1e-3, batch: int = 512, seed: int = 11) -> None:
        doc, at = self.rows(n, doc, term)
        begin = np.searchsorted(doc, np.arange(n + 1))
        base = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
        self.b = float(np.log(base / (1 - base)))
        rng = np.random.default_rng(seed)
        state = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in (("w", self.w), ("v", self.v), ("b", np.zeros(1)))}
        step = 0
        for _ in range(epochs if n else 0):
            for rows in np.array_split(rng.permutation(n), max(1, n // batch)):
                ln = begin[rows + 1] - begin[rows]
                flat = np.repeat(begin[rows], ln) + np.arange(ln.sum()) - np.repeat(np.cumsum(ln) - ln, ln)
                own, a = np.repeat(np.arange(len(rows)), ln), at[flat]
                m, s = self.margin(len(rows), own, a)
                g = (1 / (1 + np.exp(-np.clip(m, -35, 35))) - y[rows]) / len(rows)
                used, back = np.unique(a, return_inverse=True)
                gw = np.bincount(back, weights=g[own], minlength=len(used)) + l2 * self.w[used] / len(rows)
                gv = np.stack([np.bincount(back, weights=g[own] * (s[own, f] - self.v[a, f]), minlength=len(used)) for f in range(self.v.shape[1])], axis=1) + l2 * self.v[used]
                step += 1
                for k, grad, idx in (("w", gw, used), ("v", gv, used), ("b", np.array([g.sum()]), slice(None))):
                    m1, m2 = state[k]
                    m1[idx] = 0.9 * m1[idx] + 0.1 * grad
                    m2[idx] = 0.999 * m2[idx] + 0.001 * grad**2
                    move = rate * (m1[idx] / (1 - 0.9**step)) / (np.sqrt(m2[idx] / (1 - 0.999**step)) + 1e-8)
                    if k == "b":
                        self.b -= float(move[0])
                    else:
                        getattr(self, k)[idx] -= move


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "toxic", rows: int = SAMPLE_ROWS, factors: int = 6, max_terms: int = TERMS, min_docs: int = 3, min_chi: float = 20.0) -> FactorizationMachine:
    """A machine fitted on at most `rows` labelled documents outside the held-out fold.

    Executors hash the terms of the sampled texts and count, per term, the documents of each label; the max_terms terms
    with the largest chi-square stay (never one of fewer than min_docs documents or less than min_chi). A second screen admits
    terms that only tell something beside one of these, such as the name of a group beside an insult: it compares documents
    with the same strongest term of the first screen, and sums over these strata (Cochran, Mantel and Haenszel), so that a
    term has to tell more than its partner alone; its bar rises with the number of terms tested. Only those terms of the sampled texts reach the driver: at most 2 * rows * max_terms
    small integers. Null and empty texts count like others, repeated rows each, ties of chi-square go by term; with no
    labelled document the machine has no terms and a base rate of one half.
    """
    known = sampled_docs(docs, sample(labels, target, id_col, rows), id_col, text_col)
    kind = known.schema["_id"].dataType.simpleString()

    def counted(first: np.ndarray | None) -> DataFrame:
        """(stratum, term, df, pos): labelled documents by term, -1 counting all of them; strata are the place in `first` of a
        document's strongest term there, and documents without any are left out. Without `first` all are one stratum."""
        rank = None if first is None else (np.sort(first), np.argsort(first))

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, data, offsets in _lower(batches, "_text"):
                d, t = terms(Words(data, offsets, ALNUM))
                stratum = np.zeros(part.num_rows, dtype=np.int32)
                if rank is not None:
                    stratum[:] = len(first)
                    own = np.isin(t, rank[0])
                    np.minimum.at(stratum, d[own], rank[1][np.searchsorted(rank[0], t[own])].astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(part.num_rows + 1)).astype(np.int32)), pa.array(t.astype(np.int32)))
                keep = pa.array(np.flatnonzero(stratum < (1 if first is None else len(first))))
                yield pa.RecordBatch.from_arrays([part.column("_y").take(keep), pa.array(stratum).take(keep), lists.take(keep)], names=["y", "stratum", "t"])

        each = known.select("_text", "_y").mapInArrow(hashed, "y int, stratum int, t array<int>").select("y", "stratum", F.explode(F.concat("t", F.array(F.lit(-1)))).alias("term"))
        return durable(each.groupBy("stratum", "term").agg(F.count("*").alias("df"), F.sum("y").alias("pos")))

    def telling(by_term: DataFrame) -> np.ndarray:
        """Terms by their chi-square summed over strata, largest first."""
        all_ = by_term.filter("term = -1").select("stratum", F.col("df").cast("double").alias("n"), F.col("pos").cast("double").alias("p"))
        spread = F.col("df") * (F.col("n") - F.col("df")) * F.col("p") * (F.col("n") - F.col("p")) / (F.col("n") * F.col("n") * F.greatest(F.col("n") - 1, F.lit(1.0)))
        by = by_term.filter("term >= 0").join(F.broadcast(all_), "stratum").groupBy("term").agg(F.sum("df").alias("df"), F.sum(F.col("pos") - F.col("df") * F.col("p") / F.col("n")).alias("more"), F.sum(spread).alias("spread"))
        by = durable(by.filter(F.col("df") >= min_docs))
        tested = by.count()
        chi = F.round(F.col("more") * F.col("more") / F.greatest("spread", F.lit(0.25)), 9)
        # twice the logarithm of tests over a twentieth: what the largest of so many chances stays under
        least = max(min_chi, 2 * np.log(max(tested, 1) / 0.05)) if by_term is not first_count else min_chi
        top = by.select("term", chi.alias("c")).filter(F.col("c") >= least).orderBy(F.desc("c"), "term").limit(max_terms).toPandas()
        return top["term"].to_numpy(dtype=np.int64)

    first_count = counted(None)
    first = telling(first_count)
    slots = np.union1d(first, telling(counted(first))) if len(first) else first
    model = FactorizationMachine(slots, factors)

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _lower(batches, "_text"):
            d, t = terms(Words(data, offsets, ALNUM))
            own = np.isin(t, slots)
            cut = np.searchsorted(d[own], np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y"), pa.ListArray.from_arrays(pa.array(cut), pa.array(t[own].astype(np.int32)))], names=["id", "y", "t"])

    rows_ = known.select("_id", "_text", "_y").mapInArrow(active, f"id {kind}, y int, t array<int>").toArrow().sort_by("id")
    if not rows_.num_rows:
        return model
    lists = rows_.column("t").combine_chunks()
    doc = np.repeat(np.arange(rows_.num_rows), lists.value_lengths().to_numpy())
    term = lists.flatten().to_numpy().astype(np.int64)
    model.fit(rows_.num_rows, doc, term, rows_.column("y").to_numpy().astype(np.float64))
    return model


def _lower(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part, _, _ in chunks(batches, text, size=2 << 20):
        yield part, *utf8(pc.utf8_lower(pc.fill_null(part.column(text), "").cast(pa.large_string())))


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column `name`: the probability that the whole text is toxic; null and empty texts have the base rate.

    Row-local: repeated rows have equal scores, null ids pass through, an empty table gives an empty one. A column that
    is called `name` already is replaced; no other name matters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, data, offsets in _lower(batches, "text"):
            y = m.score(part.num_rows, *terms(Words(data, offsets, ALNUM)))
            cols = dict(zip(docs_columns, part.column("row").flatten(), strict=True))
            yield pa.RecordBatch.from_arrays([*(cols[c] for c in kept), pa.array(y)], names=[*kept, name])

    docs_columns = docs.columns
    return beside(docs, text_col).mapInArrow(run, StructType([*[docs.schema[c] for c in kept], StructField(name, DoubleType())]))
