"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text's terms are hashed: words by shape (case, length, signs), character pairs by class, and
coarse measures of repetition and length. Terms are weighted by log frequency and inverse document
frequency, and projected on the leading singular vectors of a bounded labelled sample. The
sample's vectors travel to every task (their number is bounded by `rows`); each text takes the
labels of its k most similar sample texts, found by exact blocked cosine products, weighted by
similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .scale import small_batches
from .text import chunks, column_bytes, mix, words

ROWS = 6000  # labelled texts that vote at most
DIMS = 48
NEIGHBOURS = 25
SHAPES, PAIRS, MEASURES = 512, 256, 128
TERMS = SHAPES + PAIRS + MEASURES
BLOCK = 1024
GRAIN = 1 << 10  # vectors are whole numbers of this fraction, so single-precision products are exact in any order
MEASURE_WEIGHT = 4.0  # of a measure against a word seen once
_U = np.uint64

# Byte classes. 0 space, 1 line end, 2 lower, 3 upper, 4 digit, 5 beyond ASCII, then signs.
_CLASS = np.full(256, 15, np.uint8)
_CLASS[[32, 9, 11, 12]] = 0
_CLASS[[10, 13]] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 5
for _i, _s in enumerate((".,;:", "!?", "#$%&*", "|", "<>{}[]()=", "/\\", "\"'`", "@", "-_+~^")):
    _CLASS[[ord(_c) for _c in _s]] = 6 + _i


def _measure(x: np.ndarray, slot: int) -> np.ndarray:
    """Bucket numbers 16 * slot + 0..15 of shares in [0, 1]."""
    return SHAPES + PAIRS + 16 * slot + np.clip((x * 15.999).astype(np.int64), 0, 15)


def terms(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, TERMS) weighted counts."""
    n = len(off) - 1
    w = words(data, off)
    cls = _CLASS[data].astype(np.int64)
    out = np.zeros((n, TERMS))
    if len(data):
        row = np.repeat(np.arange(n), np.diff(off))
        # Shape of a word: its first, last and one-before-last class, its length, its capitals.
        up = np.concatenate(([0], np.cumsum(cls == 3)))
        odd = np.concatenate(([0], np.cumsum(cls >= 6)))
        ln = w.end - w.start
        last = np.maximum(w.end - 2, w.start)
        code = (((cls[w.start] * 16 + cls[w.end - 1]) * 16 + cls[last]) * 8 + np.minimum(ln // 4, 7)) * 8 + np.minimum(up[w.end] - up[w.start], 3) * 2 + (odd[w.end] - odd[w.start] > 1)
        shape = (mix(code.astype(np.uint64)) % _U(SHAPES)).astype(np.int64)
        out[:, :SHAPES] = np.log1p(np.bincount(w.row * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES))
        same = row[1:] == row[:-1]
        pair = cls[:-1][same] * 16 + cls[1:][same]
        out[:, SHAPES : SHAPES + PAIRS] = np.log1p(np.bincount(row[:-1][same] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS))
        words_ = np.maximum(np.bincount(w.row, minlength=n), 1)
        h = np.unique((w.row.astype(np.uint64) << _U(44)) | (w.hash >> _U(20)))
        distinct = np.bincount((h >> _U(44)).astype(np.int64), minlength=n) / words_
        near = np.zeros(len(w.hash), bool)  # the same word within the last three
        for step in (1, 2, 3):
            near[step:] |= (w.hash[step:] == w.hash[:-step]) & (w.row[step:] == w.row[:-step])
        gram = mix(w.hash[:-2] + (w.hash[1:-1] << _U(1)) + (w.hash[2:] << _U(2))) if len(w.hash) > 2 else np.zeros(0, np.uint64)
        grow = w.row[:-2] if len(w.hash) > 2 else np.zeros(0, np.int64)
        g = np.unique((grow.astype(np.uint64) << _U(44)) | (gram >> _U(20)))
        fresh = np.bincount((g >> _U(44)).astype(np.int64), minlength=n) / np.maximum(np.bincount(grow, minlength=n), 1)
        size = np.maximum(np.diff(off), 1)
        share = lambda flag: np.bincount(row[flag], minlength=n) / size
        marks = [distinct, np.bincount(w.row[near], minlength=n) / words_, fresh, np.minimum(np.log1p(words_) / 12, 1), share(cls >= 6), share(cls == 3), np.minimum(share(cls == 4) * 4, 1), np.minimum(share(cls == 1) * 20, 1)]
        for slot, x in enumerate(marks):
            out[np.arange(n), _measure(x, slot)] += MEASURE_WEIGHT
    return out


def _nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, ties to the smaller column; in order of columns."""
    edge = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
    over, tie = near > edge, near == edge
    take = over | tie & (np.cumsum(tie, axis=1) <= k - over.sum(axis=1, keepdims=True))
    return np.nonzero(take)[1].reshape(len(near), k)


class Space:
    """Latent-semantic space of a labelled sample."""

    def __init__(self, x: np.ndarray, y: np.ndarray, dims: int = DIMS, k: int = NEIGHBOURS):
        self.k, self.label = k, y.astype(np.float64)
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        self.idf = np.log((len(x) + 1) / ((x > 0).sum(axis=0) + 1)) + 0.1 if len(x) else np.ones(TERMS)
        z = self._weigh(x)
        gram = z.T @ z
        _, vec = np.linalg.eigh(gram)
        self.axes = vec[:, ::-1][:, :dims]
        self.vectors = self._unit(z @ self.axes)

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        z = x * self.idf
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        """Unit vectors in whole numbers of 1 / GRAIN."""
        return np.rint(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) * GRAIN).astype(np.float32)

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among each row's nearest sample texts, by similarity."""
        if not len(self.label):
            return np.full(len(x), self.prior)
        v = self._unit(self._weigh(x) @ self.axes)
        out = np.empty(len(x))
        k = min(self.k, len(self.label))
        for lo in range(0, len(x), BLOCK):
            near = v[lo : lo + BLOCK] @ self.vectors.T
            at = _nearest(near, k)
            s = np.take_along_axis(near, at, axis=1).astype(float) / GRAIN**2
            wt = np.maximum(s, 0) ** 8 + 1e-6
            out[lo : lo + BLOCK] = ((wt * self.label[at]).sum(axis=1) + 0.2 * self.prior) / (wt.sum(axis=1) + 0.2)
        return out


def fit(docs: DataFrame, labels: DataFrame, held_out, label: str = "quality", rows: int = ROWS) -> Space:
    """Learn from at most `rows` labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = column_bytes(b.column(1))
            for lo, hi in chunks(off):
                x = terms(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    sample = labelled_sample(docs, labels, label, held_out, rows)
    got = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, x binary").toPandas().sort_values("doc_id", kind="stable")
    x = np.frombuffer(b"".join(got.x.tolist()), np.float32).reshape(-1, TERMS)
    return Space(x, got.label.to_numpy(float))


def with_score(docs: DataFrame, labels: DataFrame, held_out, label: str = "quality", rows: int = ROWS, id_col: str = "doc_id", text: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs and the score, which replaces a column of its name. One pass, no join."""
    learn = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    space = fit(learn, labels, held_out, label, rows)  # travels with the function, bounded by `rows`

    @F.pandas_udf("double")
    def vote(t: pd.Series) -> pd.Series:
        data, off = column_bytes(pa.array(t, pa.string()))
        got = [space.vote(terms(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])) for lo, hi in chunks(off)]
        return pd.Series(np.clip(np.concatenate(got), 0.0, 1.0) if got else np.zeros(0))

    return docs.withColumn(name, vote(F.col(text).cast("string")))


def score_documents(docs: DataFrame, labels: DataFrame, held_out, label: str = "quality", cut: float = 0.7, rows: int = ROWS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts have no terms and take a vote among equals; whole texts are read however
    long. Null ids are scored, not learned from, and not held out. Without usable labels every
    score is the prior 1/2. Equal texts get equal scores, however rows are dealt to tasks: cosines
    are exact and ties among neighbours fall to the one with the smaller id. An empty table gives no rows; extra columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = with_score(d, labels, held_out, label, rows)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, held_out, cut: float = 0.5, label: str = "quality", rows: int = ROWS) -> DataFrame:
    """The documents the vote does not reject (score of at least `cut`), with all their columns.

    Null and empty texts are judged like any text without terms; null ids are judged, not learned
    from. Repeated rows all stay or all go. An empty table gives no rows; no column of docs clashes.
    """
    mark = "score" + "_" * max(map(len, docs.columns))  # longer than any column of docs
    return with_score(docs, labels, held_out, label, rows, name=mark).filter(F.col(mark) >= cut).drop(mark)
