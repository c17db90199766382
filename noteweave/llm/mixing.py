"""Operator 10: mixing to target weights with soft domain membership.

A classifier trained on a labelled table gives every document a posterior over domains.
Nonnegative rates (how often a document is taken) are then fitted by least squares, so
that the expected tokens of each domain, the sum of rate x tokens x posterior, match the
targets.  The fit is a projected gradient with momentum, distributed: the gradient of
all rates needs only one number per domain, so each iteration is one aggregate over the
documents, and a document works out its rate from the list of those numbers.  The gradient
is first scaled by the inverse of the domains' Gram matrix, so that the number of steps does
not depend on how rare a domain is; targets that cannot be met are then approached by a
plain least-squares fit, and what remains is reported in a warning.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import annotate, lowest_by_hash, shared_dir, ship, stored

U64 = np.uint64
BUCKETS = 1 << 14
#: Labelled documents of each domain used for training, at most (the lowest by a hash of the id).
PER_DOMAIN = 1500
EPOCHS, RATE = 30, 0.5
#: What any domain may miss; steps of plain least squares, taken only for targets that are not met otherwise.
ITERATIONS, TOLERANCE = 100, 1e-6
#: The scaled fit goes on while so many steps halve what it misses (squared).
PATIENCE = 10
PIECE = 1 << 19


def bags(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of each lower-cased word, and the number of words by text."""
    data = K.LOWER[data]
    starts, stops, text = K.words(data, ends, K.NOT_SPACE)
    return (K.span_hashes(data, starts, stops, 7) % U64(BUCKETS)).astype(np.int64), text, K.count_by_text(text, len(ends))


class Domains:
    """Multinomial logistic regression on hashed word shares."""

    def __init__(self, texts: list[bytes], domain: list[str]):
        self.names = sorted(set(domain))
        y = np.array([self.names.index(d) for d in domain], np.int64)
        self.prior = (np.bincount(y, minlength=len(self.names)) + 1) / (len(y) + len(self.names)) if self.names else np.zeros(0)
        self.w = np.zeros((BUCKETS, len(self.names)), np.float32)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
        parts = [(i, j, *bags(d, e)) for i, j, d, e in K.pieces(data, ends, PIECE)]
        squares = np.full_like(self.w, 1e-8)
        for _ in range(EPOCHS if len(self.names) > 1 else 0):
            for i, j, bucket, text, n in parts:
                share = (1 / np.sqrt(np.maximum(n, 1)))[text].astype(np.float32)
                g = self.probability(bucket, text, n)
                g[np.arange(j - i), y[i:j]] -= 1
                rows, inverse = np.unique(bucket, return_inverse=True)
                step = np.stack([np.bincount(inverse, share * g[text, k], len(rows)) for k in range(len(self.names))], axis=1) / (j - i) + 1e-5 * self.w[rows]
                squares[rows] += step * step
                self.w[rows] -= RATE * step / np.sqrt(squares[rows])

    def probability(self, bucket: np.ndarray, text: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = np.tile(np.log(self.prior), (len(n), 1))
        some = n > 0
        if some.any():
            at = (np.cumsum(n) - n)[some]
            z[some] += np.add.reduceat(self.w[bucket], at, axis=0) / np.sqrt(n[some])[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> Domains:
    """From at most PER_DOMAIN documents of each domain; of several domains or texts of an id the least counts."""
    rows = labelled.select(F.col(id_col).cast("long").alias("id"), F.col("domain").cast("string").alias("domain")).dropna().groupBy("id").agg(F.min("domain").alias("domain"))
    sizes = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}  # a row per domain
    some = lowest_by_hash(rows, "domain", "id", PER_DOMAIN, sizes)  # its bound makes the broadcast small
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = texts.join(F.broadcast(some), "id").groupBy("id", "domain").agg(F.min("text").alias("text")).toPandas().sort_values(["id", "text"])
    return Domains([t.encode() for t in got["text"]], got["domain"].tolist())


def rates(posterior: np.ndarray, gradients: list[np.ndarray], step: float) -> tuple[np.ndarray, np.ndarray]:
    """The rates after some iterations from 1, and the point at which the next gradient is taken."""
    old = new = ahead = np.ones(len(posterior))
    t = 1.0
    for g in gradients:
        old, new = new, np.maximum(0.0, ahead - step * (posterior @ g))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, t = new + (t - 1) / t_next * (new - old), t_next
    return new, ahead


def fit(members: DataFrame, weights: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients, and the step, for rows (n_tokens, posterior binary) and target shares of all tokens."""
    sc = members.sparkSession.sparkContext
    n = len(weights)

    def total(work):
        """Sum over all rows of a vector for each batch."""
        def run(batches):
            out = np.zeros(0)
            for b in batches:
                if len(b):
                    part = work(np.frombuffer(b"".join(b.column("posterior").to_pylist())).reshape(len(b), n), b.column("n_tokens").to_numpy().astype(float))
                    out = part if not len(out) else out + part
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["i", "x"])

        got = members.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        return np.array([r.x for r in sorted(got)])

    gram = total(lambda p, t: np.append((p * t[:, None]).T @ p, t.sum()))
    if not len(gram) or gram[-1] <= 0:
        return [], 0.0
    tokens = gram[-1]
    gram = gram[:-1].reshape(n, n) / tokens
    values, vectors = np.linalg.eigh(gram)
    some = values > 1e-12 * values[-1]
    inverse = (vectors[:, some] / values[some]) @ vectors[:, some].T

    def flat(gap: np.ndarray) -> bool:
        """Whether no row's rate changes the gap's square any more: then the rates are optimal, met or not."""
        return float(gap @ gram @ gap) <= TOLERANCE**2

    def descend(scale: np.ndarray, step: float, most: float) -> tuple[list[np.ndarray], np.ndarray]:
        """Scaled gradients until the targets are met, or for at least ``most`` steps and while PATIENCE of them halve the gap; and the gap that is left."""
        gradients: list[np.ndarray] = []
        least, left, best, mark, gained = np.inf, np.zeros(n), 0, np.inf, 0
        while True:
            sent = sc.broadcast(list(gradients))
            sums = total(lambda p, t: np.concatenate([(p * (t * r)[:, None]).sum(axis=0) for r in rates(p, sent.value, step)]))
            sent.unpersist()
            gap = sums.reshape(2, n) / tokens - weights
            if np.abs(gap[0]).max() <= TOLERANCE or flat(gap[0]):
                return gradients, gap[0]
            missed = max(0.0, float(gap[0] @ scale @ gap[0]))  # rounding may turn it below 0
            if missed < mark / 2:
                mark, gained = missed, len(gradients)
            if missed < least:
                least, left, best = missed, gap[0], len(gradients)
            if len(gradients) >= most and len(gradients) - gained >= PATIENCE:
                return gradients[:best], left
            gradients.append(scale @ gap[1])

    step = 1.0
    gradients, gap = descend(inverse, step, 0)
    if np.abs(gap).max() > TOLERANCE and not flat(gap):  # no rates meet the targets: least squares, as the targets stand
        plain = 1 / max(values[-1], 1e-12)
        other, other_gap = descend(np.eye(n), plain, ITERATIONS)
        if other_gap @ other_gap <= gap @ gap:
            gradients, gap, step = other, other_gap, plain
    if np.abs(gap).max() > TOLERANCE:
        warnings.warn(f"mixing: targets are missed by up to {np.abs(gap).max():.3g} of all tokens", stacklevel=2)
    return gradients, step


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """All columns of ``docs`` and n_tokens (white-space words), domain (the likeliest), posterior, rate and copies.

    ``labelled`` has (``id_col``, domain); null ids and domains are ignored.  ``targets`` are weights, scaled
    to 1 over the domains that have training rows; a domain without one is aimed at 0.  The expected tokens
    of domain k come to its weight times all tokens, if nonnegative rates can do that, else as near as they
    can (least squares).  copies is the rate rounded up or down by a hash of the id, so that its mean is the
    rate.  A null text is empty (0 tokens, prior posterior); without any labelled domain or target every
    rate is 1 and the domain null; equal rows get equal rates; a table may be empty.  ``names`` renames the
    added columns where ``docs`` has columns of these names.
    """
    spark = docs.sparkSession
    ship(spark)
    names = {x: x for x in ("n_tokens", "domain", "posterior", "rate", "copies")} | (names or {})
    model = train(docs, labelled, id_col, text_col)
    weights = np.array([max(0.0, targets.get(d, 0.0)) for d in model.names])
    sent = spark.sparkContext.broadcast(model)

    def make():
        def work(data, ends):
            bucket, text, n = bags(data, ends)
            if not len(sent.value.names):
                return n, [None] * len(n), [[]] * len(n)
            p = sent.value.probability(bucket, text, n)
            return n, [sent.value.names[k] for k in p.argmax(axis=1)], p.tolist()

        return work

    seen = annotate(docs, text_col, make, [(names["n_tokens"], "long"), (names["domain"], "string"), (names["posterior"], "array<double>")], PIECE)
    seen = stored(seen, shared_dir(spark), "members")
    if len(model.names) and weights.sum() > 0:
        def small(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(p).tobytes() for p in b.column(1).to_pylist()], pa.binary())], ["n_tokens", "posterior"])

        members = stored(seen.select(names["n_tokens"], names["posterior"]).mapInArrow(small, "n_tokens long, posterior binary"), shared_dir(spark), "posteriors")
        gradients, step = fit(members, weights / weights.sum())
    else:
        gradients, step = [], 0.0

    schema = T.StructType([*seen.schema.fields, T.StructField(names["rate"], T.DoubleType())])

    def final(batches):
        for b in batches:
            p = np.array(b.column(names["posterior"]).to_pylist(), float).reshape(len(b), -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rates(p, gradients, step)[0] if gradients else np.ones(len(b)))], schema.names)

    out = seen.mapInArrow(final, schema)
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit("copies")), F.lit(1 << 30)) / F.lit(1 << 30)
    return out.withColumn(names["copies"], F.floor(F.col(names["rate"]) + chance).cast("int"))


#: Target shares of the languages' tokens.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def by_language(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the query and the pipeline: the language of the documents that ``labels`` lists."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("domain")).join(ids, "doc_id", "left_semi")
