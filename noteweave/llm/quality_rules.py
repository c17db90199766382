"""Operator 11: rule counts, then a logistic regression on hashed word and character n-grams.

Rules count words, symbols, repeated lines and words inside repeated windows of whole texts.  The model's
features are word 1- and 2-grams and character 3- and 4-grams (digits folded to one), hashed to BUCKETS
weights a kind of n-gram; a text's logit is the sum over the kinds of the mean weight of its n-grams.

The fit is distributed: the labelled sample is dealt to PARTS parts by a hash of the id, each part runs
EPOCHS passes of AdaGrad from the common weights, and the weights of the parts are averaged, ROUNDS times.
A part holds PER_CLASS * 2 / PARTS texts and sends one vector.  No sample row
calibrates: a fourth of the training folds, by another hash, is kept for Platt's sigmoid, which is fitted on
a histogram of the logits of *all* labelled rows of that fourth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import annotate, fold, labelled_sample, shared_dir, ship, stored

U64 = np.uint64
#: Fixed thresholds: least words, most percent of words in repeated windows, words of a window, least probability.
LEAST_WORDS, MOST_REPEATED, WINDOW, KEEP = 20, 30, 8, 0.3
WORD_GRAMS, CHAR_GRAMS = (1, 2), (3, 4)
KINDS = len(WORD_GRAMS) + len(CHAR_GRAMS)
BUCKETS = 1 << 16
#: Labelled rows of each label used for fitting, at most (the lowest by a hash of the id); not a bound of the calibration.
PER_CLASS = 4000
PARTS, ROUNDS, EPOCHS, BATCH = 8, 4, 3, 32
STEP, RIDGE, GAIN = 0.3, 1e-5, 30.0
#: One of so many training ids calibrates; bins of a unit of logit, and the largest logit told apart.
CALIBRATION, BINS, FAR = 4, 32, 40
PIECE = 1 << 18

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Digits are one character to the n-grams.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[48:58] = 48


def by_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of a value per byte over each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[ends] - sums[np.r_[0, ends[:-1]]]


def repeats(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether its text has it before (in order of place), and whether its text has it twice or more."""
    key = K.mix(keys ^ K.mix(text.astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, many = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:]] = same
    many[order[1:]] = same
    many[order[:-1]] |= same
    return again, many


def rule_counts(data: np.ndarray, ends: np.ndarray, words=None) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    starts, stops, text = words or K.words(data, ends, K.NOT_SPACE)
    n = len(ends)
    n_words = np.bincount(text, minlength=n)
    word_chars = by_text(((data & 0xC0) != 0x80) & K.NOT_SPACE[data], ends)
    n_symbols = by_text(SYMBOL[data], ends)

    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.r_[0, ends[:-1], breaks + 1]) if n else np.zeros(0, np.int64)
    line_start = line_start[line_start < len(data)]
    line_text = np.searchsorted(ends, line_start, "right")
    line_end = np.minimum(np.r_[line_start[1:], len(data)], ends[line_text])
    line_end = line_end - (data[line_end - 1] == 10)
    some = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    again, _ = repeats(K.span_hashes(data, line_start[some], line_end[some], 3), line_text[some])
    n_dup_lines = np.bincount(line_text[some][again], minlength=n)

    inside = np.zeros(len(starts) + 1, np.int64)
    window = K.window_hashes(K.span_hashes(data, starts, stops, 4), WINDOW)
    whole = np.flatnonzero(text[: len(window)] == text[WINDOW - 1:]) if len(window) else np.zeros(0, np.int64)
    _, many = repeats(window[whole], text[whole])
    np.add.at(inside, whole[many], 1)
    np.add.at(inside, whole[many] + WINDOW, -1)
    n_repeat_words = np.bincount(text[np.cumsum(inside[:-1]) > 0], minlength=n)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words]


def grams(data: np.ndarray, ends: np.ndarray, words=None):
    """(buckets, texts) of the n-grams of each kind; n-grams never cross texts."""
    starts, stops, text = words or K.words(data, ends, K.NOT_SPACE)
    data = FOLDED[data]
    word = K.span_hashes(data, starts, stops, 5)
    for width in WORD_GRAMS:
        h = K.window_hashes(word, width)
        if width > 1:  # a word after itself is one n-gram, whichever word it is
            h[word[: len(h)] == word[width - 1:]] = 0
        whole = text[: len(h)] == text[width - 1:]
        yield bucket(h[whole]), text[: len(h)][whole]
    first = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.zeros(0, U64)
    if len(first):
        value = K.byte_codes(6)[data]
        if len(first) < len(data):
            place = np.arange(len(data)) - np.repeat(first, np.diff(np.r_[first, len(data)]))
            value = value * np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], U64)[place & 3]
            value = np.add.reduceat(value, first)
        code = value
    own = np.searchsorted(ends, first, "right")
    for width in CHAR_GRAMS:
        n = max(len(code) - width + 1, 0)
        h = np.zeros(n, U64)
        for k in range(width):
            h *= U64(0x9E3779B97F4A7C15)
            h += code[k: k + n]
        whole = own[:n] == own[width - 1: width - 1 + n]
        yield bucket(K.mix(h[whole])), own[:n][whole]


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U64(48)).astype(np.int64)


class Model:
    """Weights [KINDS, BUCKETS] and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def logits(self, data: np.ndarray, ends: np.ndarray, words=None) -> np.ndarray:
        out = np.full(len(ends), self.bias)
        for w, (b, text) in zip(self.weights, grams(data, ends, words)):
            n = np.bincount(text, minlength=len(ends))
            out += GAIN * np.bincount(text, w[b], minlength=len(ends)) / np.maximum(n, 1)
        return out


def sparse(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places in the flat weights and their values, of one text."""
    places, values = [], []
    for k, (b, _) in enumerate(grams(np.frombuffer(text, np.uint8), np.array([len(text)]))):
        if len(b):
            own, n = np.unique(b, return_counts=True)
            places.append(own + k * BUCKETS)
            values.append(GAIN * n / len(b))
    return (np.concatenate(places), np.concatenate(values)) if places else (np.zeros(0, np.int64), np.zeros(0))


def improve(rows: list[tuple[np.ndarray, np.ndarray, float]], weights: np.ndarray, bias: float, squares: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """EPOCHS passes of AdaGrad over the rows; ``squares`` are the sums of squared gradients, the last one the bias's."""
    w, rng = weights.copy(), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            own = [rows[i] for i in order[k: k + BATCH]]
            size = [len(p) for p, _, _ in own]
            places, values = np.concatenate([p for p, _, _ in own]), np.concatenate([v for _, v, _ in own])
            row = np.repeat(np.arange(len(own)), size)
            z = np.bincount(row, w[places] * values, minlength=len(own)) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - np.array([y for *_, y in own])) / len(own)
            used, at = np.unique(places, return_inverse=True)
            d = np.bincount(at, g[row] * values, minlength=len(used)) + RIDGE * w[used]
            squares[used] += d * d
            w[used] -= STEP * d / (np.sqrt(squares[used]) + 1e-8)
            squares[-1] += g.sum() ** 2
            bias -= STEP * g.sum() / (np.sqrt(squares[-1]) + 1e-8)
    return w, bias


def calibrating(id_col: str):
    """Whether an id is of the fourth that calibrates and never fits."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit("calibration")), F.lit(CALIBRATION)) == 0


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", mod: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of a bounded sample of the labelled rows that neither hold out nor calibrate.

    Without both labels the logit is that of the smoothed share of label 1 for every text.  Labels of
    documents that are not there fit nothing.
    """
    sample, sizes = labelled_sample(docs, labels.filter(~calibrating(id_col)), label_col, mod, PER_CLASS, id_col, text_col)
    weights, bias = np.zeros(KINDS * BUCKETS), 0.0
    if min(sizes.get(0, 0), sizes.get(1, 0)) == 0:
        return Model(weights.reshape(KINDS, BUCKETS).astype(np.float32), float(np.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1))))
    ship(docs.sparkSession)
    sample = stored(sample.withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(PARTS)).cast("int")), shared_dir(docs.sparkSession), "sample")
    for r in range(ROUNDS):
        sent = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))

        def run(batches, sent=sent, seed=r):
            parts: dict[int, list] = {}
            for b in batches:
                for part, i, text, y in zip(*(b.column(c).to_pylist() for c in ("part", "id", "text", "y"))):
                    parts.setdefault(part, []).append((i, text, y))
            start, start_bias = sent.value
            for part, rows in sorted(parts.items()):
                rows = [(*sparse(t.encode()), float(y)) for _, t, y in sorted(rows)]
                w, b0 = improve(rows, start.astype(float), start_bias, np.full(KINDS * BUCKETS + 1, 1e-4), 97 * seed + part)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([b0])], ["part", "w", "bias"])

        found = sample.repartition(PARTS, "part").mapInArrow(run, "part int, w binary, bias double").collect()  # one vector a part
        sent.unpersist()
        if not found:  # labels of absent documents only
            break
        found.sort(key=lambda x: x["part"])
        weights = np.mean([np.frombuffer(x["w"], np.float32).astype(float) for x in found], axis=0)
        bias = float(np.mean([x["bias"] for x in found]))
    return Model(weights.reshape(KINDS, BUCKETS).astype(np.float32), bias)


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a z + b))), by Newton steps on Platt's smoothed targets; (1, 0) without both labels."""
    up, down = weight[y > 0].sum(), weight[y == 0].sum()
    if not up or not down:
        return 1.0, 0.0
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([z, np.ones(len(z))], axis=1)

    def loss(t):
        s = x @ t
        return (weight * (np.logaddexp(0, s) - target * s)).sum()

    t = np.array([0.0, np.log((up + 1) / (down + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -500, 500)))
        g = x.T @ (weight * (p - target))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-12))[:, None]).T @ x + 1e-9 * np.eye(2)
        move, scale = np.linalg.solve(h, g), 1.0
        while scale > 1e-6 and loss(t - scale * move) > loss(t):
            scale /= 2
        t = t - scale * move
        if np.abs(scale * move).max() < 1e-9:
            break
    return (float(t[0]), float(t[1])) if t[0] > 0 else (0.0, float(np.log((up + 1) / (down + 1))))


def calibration(scored: DataFrame, labels: DataFrame, label_col: str = "quality", mod: int = 5, id_col: str = "doc_id") -> tuple[float, float]:
    """Platt's sigmoid of all labelled rows of the calibrating fourth, from their histogram of logits."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (fold("id", mod) != 0) & calibrating("id")).groupBy("id").agg(F.max("y").alias("y"))
    own = scored.select(F.col("doc_id").alias("id"), "logit").filter(F.col("id").isNotNull() & (fold("id", mod) != 0) & calibrating("id")).groupBy("id").agg(F.min("logit").alias("logit"))
    at = F.round(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col("logit"))) * BINS).cast("int")
    cells = own.join(rows, "id").groupBy(at.alias("at"), "y").count().orderBy("at", "y").collect()  # at most 2 * (2 * FAR * BINS + 1) rows
    return platt(np.array([c["at"] / BINS for c in cells]), np.array([c["y"] for c in cells]), np.array([float(c["count"]) for c in cells]))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(docs: DataFrame, labels: DataFrame, keep: float = KEEP, mod: int = 5, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, held_out, score) of every row.

    A null text counts as empty, has no words and fails; repeated rows each give a row; a null id is never
    held out; further columns are ignored.  Null labels are ignored, the larger of conflicting ones counts;
    without both labels every score is the smoothed share of label 1.  Tables may be empty.
    """
    spark = docs.sparkSession
    model = fit(docs, labels, label_col, mod, id_col, text_col)
    sent = spark.sparkContext.broadcast(model)

    def make():
        def work(data, ends):
            words = K.words(data, ends, K.NOT_SPACE)
            return [*rule_counts(data, ends, words), sent.value.logits(data, ends, words)]
        return work

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = annotate(rows, "text", make, [*((c, "long") for c in COUNTS), ("logit", "double")], PIECE).drop("text")
    scored = stored(scored, shared_dir(spark), "scored")
    a, b = calibration(scored, labels, label_col, mod)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = scored.withColumn("score", 1 / (1 + F.exp(-(F.lit(a) * F.col("logit") + F.lit(b)))))
    return out.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("score") >= keep)).alias("kept"), F.coalesce(fold("doc_id", mod) == 0, F.lit(False)).alias("held_out"), "score")
