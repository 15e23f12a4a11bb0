"""Quality by nearest-neighbour voting in a latent semantic space.

A text is a bag of terms of its form: hashed trigrams of byte classes (case, digits, blanks,
kinds of punctuation), weighted by tf-idf, and the share of its words that are distinct, as two
neighbouring bins.  A truncated singular value decomposition of the labelled texts' matrix gives
the latent space.  The labelled vectors, a bounded sample, are broadcast; each document's cosine
with every one of them is computed in blocks, and the nearest vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as T
from .store import on_workers, release

#: Bound of the labelled sample; rows are chosen by a hash of their id.
MAX_LABELLED = 2000
CLASSES, BINS, RANK, NEIGHBOURS = 16, 24, 48, 25
#: How much the share of distinct words weighs against the trigrams.
SHARE_WEIGHT = 1.0
FEATURES = CLASSES**3 + BINS


def byte_classes() -> np.ndarray:
    """Lower and upper case, digits, blanks, the kinds of punctuation, and what is beyond ASCII."""
    out = np.full(256, 12, np.uint8)
    for k, (a, b) in enumerate(((97, 123), (65, 91), (48, 58))):
        out[a:b] = k
    for k, chars in enumerate((b" \t", b"\r\n", b".", b",;:", b"!", b"?", b"'\"", b"|", b"#*&%$@"), 3):
        out[list(chars)] = k
    out[128:192], out[192:] = 13, 14
    return out


_CLASS = byte_classes()


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the trigrams and weights of the two bins, a row for each text."""
    rows = len(offsets) - 1
    out = np.zeros((rows, FEATURES), np.float32)
    kind = _CLASS[data].astype(np.int64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    if len(kind) > 2:
        key = (row[:-2] * CLASSES**3 + (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:])[row[:-2] == row[2:]]
        out[:, : CLASSES**3] = np.bincount(key, minlength=rows * CLASSES**3).reshape(rows, -1)
    start, end, at = T.words(data, offsets, T.BLANK_WORDS)
    hashes = T.word_hashes(T.LOWER[data], start, end)
    for i in range(rows):
        n = at[i + 1] - at[i]
        if n:
            bin_at = len(np.unique(hashes[at[i] : at[i + 1]])) / n * (BINS - 2)
            low = int(bin_at)
            out[i, CLASSES**3 + low : CLASSES**3 + low + 2] = (low + 1 - bin_at, bin_at - low)
    return out


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; zero for an empty text."""
        z = weighted(x, self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z, out = self.project(x), np.full(len(x), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(z) if k else 0, 256):
            cosine = z[a : a + 256] @ self.vectors.T
            # every neighbour as near as the k-th votes, so ties don't depend on an order
            least = np.partition(cosine, -k, axis=1)[:, -k, None]
            weight = np.where((cosine >= least) & (cosine > 0), cosine, 0).astype(np.float64)
            total = weight.sum(axis=1)
            out[a : a + 256] = np.where(total > 0, (weight * self.labels).sum(axis=1) / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0, 1)


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    grams = np.log1p(x[:, : CLASSES**3]) * idf
    grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-12)
    bins = x[:, CLASSES**3 :]
    return np.concatenate((grams, bins * (SHARE_WEIGHT / np.maximum(np.linalg.norm(bins, axis=1, keepdims=True), 1e-12))), axis=1)


def fit(x: np.ndarray, labels: np.ndarray) -> Model:
    if not len(x):
        return Model(np.zeros(CLASSES**3, np.float32), np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
    idf = np.log((1 + len(x)) / (1 + (x[:, : CLASSES**3] > 0).sum(axis=0))).astype(np.float32) + 1
    w = weighted(x, idf)
    # randomized range finder (Halko et al., 2011), then an exact decomposition in it
    rank = min(RANK, *w.shape)
    q = np.linalg.qr(w @ np.random.default_rng(11).standard_normal((w.shape[1], min(rank + 16, w.shape[0]))).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(w @ (w.T @ q))[0]
    basis = np.linalg.svd(q.T @ w, full_matrices=False)[2][:rank].T.astype(np.float32)
    model = Model(idf, basis, np.zeros((0, rank), np.float32), labels.astype(np.float64), float(labels.mean()))
    model.vectors = model.project(x)
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in T.chunks(batch.column(2)):
            held = [r.tobytes() for r in terms(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(held, pa.binary())], names=["doc_id", "quality", "terms"])
    release()


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_labelled: int = MAX_LABELLED) -> Model:
    """A model of labels (doc_id, quality) of which ``learn`` holds, ``max_labelled`` at most.

    Labels that are null or not 0 or 1, or of no document, teach nothing and use up no place.
    Repeated labels count each.  Without any, or without documents, every score is 0.5.  Texts of
    any length are read whole; other columns, whatever their names, are not read.
    """
    on_workers(docs.sparkSession)
    usable = labels.filter(learn & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = usable.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    some = known.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id", "quality").limit(max_labelled)
    # the sample's bound proves the size of what is broadcast
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text")
    rows = sorted(((r.doc_id, r.quality, bytes(r.terms)) for r in found.mapInArrow(_features, "doc_id long, quality int, terms binary").toLocalIterator(prefetchPartitions=True)), key=lambda r: (r[0], r[1], r[2]))
    x = np.stack([np.frombuffer(t, np.float32) for _, _, t in rows]) if rows else np.zeros((0, FEATURES), np.float32)
    marked = np.array([q for _, q, _ in rows], np.float64)
    del rows
    return fit(x, marked)


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch.column(1), 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.value.scores(terms(data, offsets)))], names=["doc_id", "score"])
        release()

    return run


def _keeps(model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.value.scores(terms(data, offsets)) >= least for _, _, data, offsets in T.chunks(batch.column(batch.schema.get_field_index("text")), 1 << 20)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))
        release()

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of docs (doc_id, text, ...): the weighted share of neighbours labelled 1.

    A null or empty text has no direction and gets the labelled sample's share of 1.  Repeated rows
    score alike, each with its row; neighbours tied with the last one that votes vote as well.
    """
    on_workers(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scores(held), "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score ``least`` or more; null and empty texts as ``score`` has them."""
    on_workers(docs.sparkSession)
    return docs.mapInArrow(_keeps(docs.sparkSession.sparkContext.broadcast(model), least), docs.schema)
