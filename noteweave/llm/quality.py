"""Operator 7: quality by random-indexing word vectors and a two-layer network.

A text is a sequence of units: each white-space token gives its shape (runs of
character classes) and its word (letters and digits, lower-cased).  Every unit has a
fixed sparse ternary index vector.  Random indexing adds up, over all documents, the
index vectors of a unit's neighbours; units are hashed to a fixed number of buckets, so
the table's size does not grow with the corpus.  A document is the mean of its units'
vectors, the mean index vector of its shapes and a few rates; a two-layer network turns
it into a logit, whose temperature is fitted on rows that the network has not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import annotate, fold, labelled_sample, ship

U64 = np.uint64
BUCKETS, DIM, NONZERO = 1 << 14, 32, 4
#: Rows of the unit table that are added up as one row of the shuffle.
STRIPE = 256
#: Labelled documents of each class used for training, at most (the lowest by a hash of the id).
PER_CLASS = 8000
HIDDEN, EPOCHS, BATCH = 32, 40, 128
#: Of the sample, kept for the temperature.
CALIBRATION_SHARE = 0.25
PIECE = 1 << 18

#: 1 upper, 2 lower, 3 digit, 4 beyond ASCII, else the character itself.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:] = 1, 2, 3, 4


def units(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shape bucket, word bucket, text) of each token, and whether it repeats the token before."""
    starts, stops, text = K.words(data, ends, K.NOT_SPACE)
    kind = CLASS[data]
    first = np.ones(len(data), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[starts] = True
    at = np.r_[0, np.cumsum(first)]
    shape = K.span_hashes(kind[first], at[starts], at[stops], 1)
    low = K.LOWER[data]
    letters = K.ALNUM[low]
    at = np.r_[0, np.cumsum(letters)]
    word = K.span_hashes(low[letters], at[starts], at[stops], 2)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1]) & (shape[1:] == shape[:-1])
    return (shape % U64(BUCKETS)).astype(np.int64), (word % U64(BUCKETS)).astype(np.int64), text, again


def index_table() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zero components of each bucket's index vector."""
    h = K.mix(np.arange(1, BUCKETS * NONZERO + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(BUCKETS, NONZERO)
    return (h % U64(DIM)).astype(np.int64), np.where((h >> U64(40)) & U64(1), 1.0, -1.0)


def index_vectors() -> np.ndarray:
    places, signs = index_table()
    out = np.zeros((BUCKETS, DIM), np.float32)
    np.add.at(out, (np.arange(BUCKETS)[:, None], places), signs)
    return out


def sequence(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units in order (shape, word, shape, word, ...) and their texts."""
    shape, word, text, _ = units(data, ends)
    return np.stack([shape, word], axis=1).ravel(), np.repeat(text, 2)


def unit_vectors(docs: DataFrame, text_col: str = "text", reach: int = 2) -> np.ndarray:
    """[BUCKETS, DIM]: sums of the index vectors of neighbours over all documents, scaled to length 1."""
    def gather(batches):
        vectors, total = index_vectors(), np.zeros((BUCKETS, DIM))
        for b in batches:
            for _, _, data, ends in K.pieces(*K.texts(b.column(0)), PIECE):
                unit, text = sequence(data, ends)
                if not len(unit):
                    continue
                around = np.zeros((len(unit), DIM), np.float32)
                for off in range(1, reach + 1):
                    same = text[off:] == text[:-off]
                    own = vectors[unit] if off == 1 else own
                    around[off:][same] += own[:-off][same]
                    around[:-off][same] += own[off:][same]
                order = np.argsort(unit, kind="stable")
                used, at = np.unique(unit[order], return_index=True)
                total[used] += np.add.reduceat(around[order], at, axis=0)
        rows = [(k, total[k * STRIPE: (k + 1) * STRIPE]) for k in range(BUCKETS // STRIPE)]
        rows = [(k, x.tobytes()) for k, x in rows if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["stripe", "part"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("stripe").to_pylist(), b.column("part").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["stripe", "part"])

    ship(docs.sparkSession)
    parts = docs.select(text_col).mapInArrow(gather, "stripe int, part binary").repartition(BUCKETS // STRIPE, "stripe").mapInArrow(add, "stripe int, part binary")
    out = np.zeros((BUCKETS, DIM))
    for r in parts.collect():  # BUCKETS rows of the table at most, whatever the corpus
        out[r.stripe * STRIPE: (r.stripe + 1) * STRIPE] = np.frombuffer(r.part).reshape(STRIPE, DIM)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.where(length > 0, length, 1)).astype(np.float32)


def features(data: np.ndarray, ends: np.ndarray, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """[texts, 2 * DIM + 4]: pooled unit vectors, pooled shape index vectors, rates; zeros for an empty text."""
    shape, word, text, again = units(data, ends)
    n = np.bincount(text, minlength=len(ends)).astype(float)
    some = n > 0
    out = np.zeros((len(ends), 2 * DIM + 4), np.float32)
    if some.any():
        at = (np.cumsum(n) - n).astype(np.int64)[some]
        out[some, :DIM] = np.add.reduceat(vectors[shape] + vectors[word], at, axis=0) / (2 * n[some, None])
        out[some, DIM: 2 * DIM] = np.add.reduceat(index[shape], at, axis=0) / n[some, None]
        out[some, 2 * DIM] = np.add.reduceat(again.astype(float), at) / n[some]
        order = np.lexsort((word, text))
        new = np.ones(len(word), bool)
        new[1:] = (word[order][1:] != word[order][:-1]) | (text[1:] != text[:-1])
        out[some, 2 * DIM + 1] = np.add.reduceat(new.astype(float), at) / n[some]
    size = np.diff(np.r_[0, ends])
    out[:, 2 * DIM + 2] = np.log1p(n)
    out[:, 2 * DIM + 3] = size / np.maximum(n, 1) / 10
    return out


class Network:
    """Two layers in numpy: tanh, then one logit, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.temperature = 1.0
        self.w = [rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.w]
        z, step = (x - self.mean) / self.scale, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(z))
            for k in range(0, len(z), BATCH):
                own = order[k: k + BATCH]
                h = np.tanh(z[own] @ self.w[0] + self.w[1])
                p = 1 / (1 + np.exp(-(h @ self.w[2] + self.w[3])))
                g = (p - y[own]) * weight[own] / len(own)
                back = np.outer(g, self.w[2]) * (1 - h * h)
                grads = [z[own].T @ back + 1e-4 * self.w[0], back.sum(axis=0), h.T @ g + 1e-4 * self.w[2], np.array([g.sum()])]
                step += 1
                for p_, g_, (m, v) in zip(self.w, grads, moments):
                    m += 0.1 * (g_ - m)
                    v += 0.001 * (g_ * g_ - v)
                    p_ -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature of least loss on rows that were not trained on."""
        z = self.logit(x)
        grid = np.geomspace(0.25, 16, 49)
        loss = [(weight * np.logaddexp(0, np.where(y > 0, -z, z) / t)).sum() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


class Constant:
    """Stands in for a network where only one label, or none, was given."""

    def __init__(self, p: float):
        self.p = p

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", mod: int = 5, text_col: str = "text", id_col: str = "doc_id"):
    """(unit vectors from all documents, network from a bounded sample of the labelled rows whose fold is not 0)."""
    vectors, index = unit_vectors(docs, text_col), index_vectors()
    sent = docs.sparkSession.sparkContext.broadcast((vectors, index))
    sample, sizes = labelled_sample(docs, labels, label_col, mod, PER_CLASS, id_col, text_col)

    def make():
        return lambda data, ends: [[x.tobytes() for x in features(data, ends, *sent.value)]]

    rows = annotate(sample, "text", make, [("x", "binary")], PIECE).select("id", "x", "y").toPandas().sort_values(["id", "x"])  # at most 2 * PER_CLASS short rows
    y = rows["y"].to_numpy(float)
    if len(set(y)) < 2:
        return vectors, Constant((sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2))
    x = np.stack([np.frombuffer(b, np.float32) for b in rows["x"]]).astype(float)
    weight = np.where(y > 0, sizes[1] / (y > 0).sum(), sizes[0] / (y == 0).sum())
    weight /= weight.mean()
    kept = np.random.default_rng(1).random(len(y)) < CALIBRATION_SHARE
    if len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
        kept[:] = False
    net = Network(x[~kept], y[~kept], weight[~kept])
    if kept.any():
        net.calibrate(x[kept], y[kept], weight[kept])
    return vectors, net


def score(docs: DataFrame, model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability of label 1, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast((*model, index_vectors()))

    def make():
        vectors, net, index = sent.value
        return lambda data, ends: [net.probability(features(data, ends, vectors, index)).astype(float)]

    return annotate(docs, text_col, make, [(name, "double")], PIECE)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 5, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null text counts as empty and gets the score of an empty text; a null id is never held out; repeated
    rows each give a row; further columns are ignored.  Null labels are ignored, the larger of conflicting
    ones counts; without both labels every score is the smoothed share of label 1.  Tables may be empty.
    """
    model = train(docs, labels, label_col, mod, text_col, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = score(rows, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", mod) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
