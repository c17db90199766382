"""Operator 8: toxicity by a convolutional text classifier in numpy.

A word's vector is the sum of hashed embeddings of the word and of its beginnings (so an
inflected word shares most of its vector with its stem).  Filters of one, two and three
words slide over the text; each gives its largest activation (max pooling) and the
logarithm of its activation by 100 words, and a linear layer turns them into a logit.

The threshold is calibrated by language on rows that training has not seen.  The
language is read off the text's function words, never off a column; the logit is shifted
by the language's threshold, so that 0.5 is the decision for every text.

The network learns from all labelled texts: it starts on a sample in the driver (PER_CLASS of each
class), and if there are more, goes on from there over all of them in parts, dealt to tasks by their ids;
the parts' networks are averaged, first in their task, so at most TASKS networks are shuffled.  The thresholds come from all calibration rows, counted by language,
label and place of the logit.

For scoring, embeddings and filters are multiplied once into a table of filter responses
by bucket, and each distinct word of a piece of text is looked up once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import annotate, arrow_rows, fold, labelled_ids, labelled_sample, labelled_texts, release, ship

U64 = np.uint64
BUCKETS, DIM = 1 << 16, 12
#: Lengths, in bytes, of the beginnings that have embeddings of their own.
STEMS = (4, 5, 6, 7, 8)
WIDTHS, FILTERS = (1, 2, 3), 8
#: Labelled documents of each class with which training starts, at most; the others follow in parts of PART documents.
PER_CLASS = 2500
PART = 1500
#: Tasks that train and documents of an Arrow batch, at most; a network has about 3 MB, whatever it learnt from.
TASKS, ROWS = 32, 500
#: Places of a logit told apart when thresholds are chosen, by unit; and the largest place.
PLACES, FAR = 64, 1 << 13
#: Numbers of a network that travel together when networks are averaged.
SLICE = 1 << 15
EPOCHS, BATCH, RATE = 6, 32, 0.08
#: Share of words left out of each training step, anew each time, so that no word relies on its company.
DROPPED = 0.4
CALIBRATION_SHARE = 0.3
#: Words to which the mean of a filter's activations is scaled.
RATE_OF = 100
#: Calibration rows of each label that a language needs for a threshold of its own.
LEAST = 20
#: What a wrongly flagged text costs against a missed one when a threshold is chosen.
FALSE_ALARM = 1.0
PIECE = 1 << 19

#: Common function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with be by on not he as you are this at from have or an they which one had",
    "fr": "le la les des et est une du pour que qui dans sur pas au ne se ce il avec sont par plus",
    "es": "el los las del y en que un una por con para no su al lo como es más se",
    "de": "der die das und ist von mit den zu ein eine dem nicht sich auf für im des auch als",
}


def hashed(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    stop = np.cumsum([len(w) for w in words])
    return K.span_hashes(data, np.r_[0, stop[:-1]], stop)


LANGUAGES = sorted(FUNCTION_WORDS)
_WORDS = {name: np.sort(hashed([w.encode() for w in FUNCTION_WORDS[name].split()])) for name in LANGUAGES}


class Text:
    """Words of some texts: the buckets of each distinct word's parts, and the words in order."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        data = K.LOWER[data]
        starts, stops, self.text = K.words(data, ends, K.ALNUM)
        h = K.span_hashes(data, starts, stops)
        self.n = len(ends)
        self.counts = K.count_by_text(self.text, self.n)
        distinct, first, self.word = np.unique(h, return_index=True, return_inverse=True)
        at, size = starts[first], stops[first] - starts[first]
        parts, owner = [distinct], [np.arange(len(distinct))]
        for k in STEMS:
            long = np.flatnonzero(size > k)
            parts.append(K.span_hashes(data, at[long], at[long] + k, 100 + k) if len(long) else distinct[:0])
            owner.append(long)
        parts, owner = np.concatenate(parts), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.bucket = (parts[order] % U64(BUCKETS)).astype(np.int64)
        self.share = np.bincount(owner, minlength=len(distinct))
        self.begin = np.cumsum(self.share) - self.share
        languages = np.stack([np.isin(distinct, _WORDS[name]) for name in LANGUAGES], axis=1) if len(distinct) else np.zeros((0, len(LANGUAGES)), bool)
        votes = np.stack([np.bincount(self.text, languages[self.word, i], self.n) for i in range(len(LANGUAGES))], axis=1) if len(h) else np.zeros((self.n, len(LANGUAGES)))
        #: Place in LANGUAGES, or their number where no function word occurs.
        self.language = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(LANGUAGES))

    def summed(self, table: np.ndarray) -> np.ndarray:
        """Sum of the table's rows over each distinct word's parts, divided by the root of their number."""
        if not len(self.share):
            return np.zeros((0, table.shape[1]), table.dtype)
        return np.add.reduceat(table[self.bucket], self.begin, axis=0) / np.sqrt(self.share)[:, None].astype(table.dtype)

    def whole(self, width: int) -> np.ndarray:
        """Words at which a run of ``width`` words of one text starts."""
        n = len(self.text) - width + 1
        return np.flatnonzero(self.text[:n] == self.text[width - 1:]) if n > 0 else np.zeros(0, np.int64)


class Cnn:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.full(FILTERS, 0.0, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, 2 * FILTERS * len(WIDTHS)).astype(np.float32)
        self.offset = np.full(1, -2, np.float32)  # a text without evidence is not toxic
        self.thresholds, self.slope = np.zeros(len(LANGUAGES) + 1), 1.0

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, *self.bias, self.out, self.offset]

    def tables(self) -> np.ndarray:
        """[BUCKETS, all places of all filters]: responses of the filters to each bucket."""
        return np.concatenate([self.embedding @ f[i] for f in self.filters for i in range(len(f))], axis=1)

    def pooled(self, t: Text, words: list[list[np.ndarray]]) -> tuple[np.ndarray, list]:
        """[texts, 2 * filters]: maxima and logarithmic rates of activations; and what the gradient needs."""
        tops, sums, kept = [], [], []
        for w, parts, bias in zip(WIDTHS, words, self.bias):
            at = t.whole(w)
            z = bias + sum(p[t.word[at + i]] for i, p in enumerate(parts)) if len(at) else np.zeros((0, FILTERS), np.float32)
            z = np.maximum(z, 0)
            owner = t.text[at]
            n = np.bincount(owner, minlength=t.n)
            some, first = np.flatnonzero(n), (np.cumsum(n) - n)[n > 0]
            top, total = np.zeros((t.n, FILTERS), np.float32), np.zeros((t.n, FILTERS), np.float32)
            if len(some):
                top[some] = np.maximum.reduceat(z, first, axis=0)
                total[some] = np.add.reduceat(z, first, axis=0) * (RATE_OF / n[some, None]).astype(np.float32)
            tops.append(top)
            sums.append(np.log1p(total))
            kept.append((at, owner, z, top, total, (RATE_OF / np.maximum(n, 1)).astype(np.float32)))
        return np.concatenate(tops + sums, axis=1), kept

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.out + self.offset

    def step(self, t: Text, y: np.ndarray, weight: np.ndarray, squares: list[np.ndarray], embedding_squares: np.ndarray) -> None:
        """One Adagrad update on some texts."""
        e = t.summed(self.embedding)
        x, kept = self.pooled(t, [[e @ f[i] for i in range(len(f))] for f in self.filters])
        g = ((1 / (1 + np.exp(-np.clip(self.logit(x), -60, 60))) - y) * weight / t.n).astype(np.float32)
        back = g[:, None] * self.out
        grads = {"out": x.T @ g + 1e-4 * self.out, "offset": g.sum(keepdims=True)}
        de = np.zeros_like(e)
        d_filters, d_bias = [], []
        for k, (w, (at, owner, z, top, total, scale)) in enumerate(zip(WIDTHS, kept)):
            g_top = back[:, k * FILTERS: (k + 1) * FILTERS]
            g_sum = back[:, (len(WIDTHS) + k) * FILTERS: (len(WIDTHS) + k + 1) * FILTERS] * scale[:, None] / (1 + total)
            dz = (g_sum[owner] + np.where(z == top[owner], g_top[owner], 0)) * (z > 0)
            row = np.flatnonzero(dz.any(axis=1))
            at, dz = at[row], dz[row]
            d_bias.append(dz.sum(axis=0))
            d_filters.append(np.stack([e[t.word[at + i]].T @ dz for i in range(w)]))
            for i in range(w):
                np.add.at(de, t.word[at + i], dz @ self.filters[k][i].T)
        used = np.flatnonzero(de.any(axis=1))
        from_part = K.ranges(t.begin[used], t.share[used])
        bucket = t.bucket[from_part]
        rows, inverse = np.unique(bucket, return_inverse=True)
        d_rows = np.zeros((len(rows), DIM), np.float32)
        np.add.at(d_rows, inverse, np.repeat(de[used] / np.sqrt(t.share[used])[:, None].astype(np.float32), t.share[used], axis=0))
        embedding_squares[rows] += d_rows * d_rows
        self.embedding[rows] -= RATE * d_rows / np.sqrt(embedding_squares[rows] + 1e-8)
        for p, d, s in zip(self.parameters(), [*d_filters, *d_bias, grads["out"], grads["offset"]], squares):
            s += d * d
            p -= RATE * d / np.sqrt(s + 1e-8)

    def fit(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray, seed: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
        """Train on some texts; the sums of squared gradients, with which training can go on."""
        rng = np.random.default_rng(seed)
        squares = [np.full_like(p, 1e-3) for p in self.parameters()]
        embedding_squares = np.full_like(self.embedding, 1e-4)
        for _ in range(EPOCHS):
            self.epoch(texts, y, weight, squares, embedding_squares, rng)
        return squares, embedding_squares

    def epoch(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray, squares: list[np.ndarray], embedding_squares: np.ndarray, rng: np.random.Generator) -> None:
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            own = order[k: k + BATCH]
            t = joined([texts[i] for i in own])
            kept = rng.random(len(t.text)) >= DROPPED
            t.text, t.word = t.text[kept], t.word[kept]
            self.step(t, y[own], weight[own], squares, embedding_squares)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (self.embedding, *self.parameters())])

    def take(self, values: np.ndarray) -> None:
        """Set all that is learnt from what ``flat`` gives."""
        at = 0
        for p in (self.embedding, *self.parameters()):
            p[...] = values[at: at + p.size].reshape(p.shape)
            at += p.size

    def logits(self, t: Text, table: np.ndarray) -> np.ndarray:
        e, parts, at = t.summed(table), [], 0
        for w in WIDTHS:
            parts.append([e[:, at + i * FILTERS: at + (i + 1) * FILTERS] for i in range(w)])
            at += w * FILTERS
        return self.logit(self.pooled(t, parts)[0]).astype(float)

    def calibrate(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray, language: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Thresholds of least weighted error, for each language with enough rows; others take that of all.

        ``rows``: for how many rows each value stands, if not for one.
        """
        rows = np.ones(len(z)) if rows is None else rows
        common = threshold(z, y, weight)
        for k in range(len(self.thresholds)):
            own = language == k
            enough = min(rows[own & (y > 0)].sum(), rows[own & (y == 0)].sum()) >= LEAST
            self.thresholds[k] = threshold(z[own], y[own], weight[own]) if enough else common

    def probability(self, t: Text, table: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(t, table) - self.thresholds[t.language], -500, 500)))


def threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Between two neighbouring values; of equally good places the middle of the widest."""
    order = np.argsort(z)
    z, y, weight = z[order], y[order], weight[order]
    miss = np.r_[0, np.cumsum(weight * (y > 0))]
    alarm = FALSE_ALARM * (weight * (y == 0)).sum() - np.r_[0, np.cumsum(FALSE_ALARM * weight * (y == 0))]
    cost = miss + alarm
    edges = np.r_[z[0] - 1, z, z[-1] + 1]
    good = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = good[np.argmax(edges[good + 1] - edges[good])]
    return float((edges[k] + edges[k + 1]) / 2)


def joined(texts: list[bytes]) -> Text:
    return Text(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts]))


class Constant:
    def __init__(self, p: float):
        self.p = p

    def tables(self) -> None:
        return None

    def probability(self, t: Text, table) -> np.ndarray:
        return np.full(t.n, self.p)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", mod: int = 5, text_col: str = "text", id_col: str = "doc_id"):
    """A network from all whole labelled texts whose fold is not 0."""
    sample, sizes = labelled_sample(docs, labels, label_col, mod, PER_CLASS, id_col, text_col)
    more = max(sizes.values(), default=0) > PER_CLASS  # the sample is not all
    rows = sample.withColumn("kept", _calibrates()).toPandas().sort_values(["id", "text"])  # at most 2 * PER_CLASS texts
    y = rows["y"].to_numpy(float)
    if len(set(y)) < 2:
        return Constant((sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2))
    texts = [x.encode() for x in rows["text"]]
    natural = np.where(y > 0, sizes[1] / (y > 0).sum(), sizes[0] / (y == 0).sum())
    even = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y == 0).sum()))
    kept = rows["kept"].to_numpy(bool).copy() if more else np.random.default_rng(1).random(len(y)) < CALIBRATION_SHARE
    if min((kept & (y > 0)).sum(), (kept & (y == 0)).sum(), (~kept & (y > 0)).sum(), (~kept & (y == 0)).sum()) < 1:
        kept[:] = False
    net = Cnn()
    state = net.fit([t for t, k in zip(texts, kept) if not k], y[~kept], even[~kept])
    if more:
        every = labelled_texts(docs, labelled_ids(labels, label_col, mod, id_col), -(-sum(sizes.values()) // PART), id_col, text_col)
        with arrow_rows(docs.sparkSession, ROWS):
            _go_on(every.filter(~_calibrates()) if kept.any() else every, net, state, sizes)
            release(docs.sparkSession)
            _calibrate(every.filter(_calibrates()) if kept.any() else every, net)
        return net
    own = kept if kept.any() else ~kept
    table, z, language = net.tables(), [], []
    some = [t for t, k in zip(texts, own) if k]
    for k in range(0, len(some), 100):
        t = joined(some[k: k + 100])
        z.append(net.logits(t, table))
        language.append(t.language)
    net.calibrate(np.concatenate(z), y[own], natural[own], np.concatenate(language))
    return net


def _calibrates():
    """Whether a row is for the thresholds and not for training: a fixed share of the ids by their hash."""
    return F.pmod(F.xxhash64(F.lit("calibration"), F.col("id")), F.lit(1000)) < int(1000 * CALIBRATION_SHARE)


def _networks(rows: DataFrame, sent, even: list[float]) -> DataFrame:
    """(slice, n, v) of each task's network: the mean, by their rows, of the networks of its parts of PART documents, each
    gone on from the network that is ``sent``."""

    def learn(batches):
        own, state = sent.value
        model, total, n, done = Cnn(), 0, 0, 0
        rng = np.random.default_rng(0)
        for b in batches:
            if not len(b):
                continue
            if n >= PART:
                total, done, n = total + n * model.flat().astype(float), done + n, 0
            if not n:
                model.take(own.flat())
                squares, embedding_squares = [x.copy() for x in state[0]], state[1].copy()
            y = b.column("y").to_numpy().astype(float)
            model.epoch([x.encode() for x in b.column("text").to_pylist()], y, np.where(y > 0, even[1], even[0]), squares, embedding_squares, rng)
            n += len(y)
        if n:
            values = ((total + n * model.flat().astype(float)) / (done + n)).astype(np.float32)
            cuts = range(0, len(values), SLICE)
            yield pa.RecordBatch.from_arrays([pa.array([at // SLICE for at in cuts], pa.int32()), pa.array([done + n] * len(cuts), pa.int64()),
                                              pa.array([values[at: at + SLICE].tobytes() for at in cuts], pa.binary())], ["slice", "n", "v"])

    return rows.coalesce(TASKS).mapInArrow(learn, "slice int, n long, v binary")


def _go_on(rows: DataFrame, net: Cnn, state: tuple, sizes: dict[int, int]) -> None:
    """One pass over all rows: each part goes on from the network it is given; the parts' networks are averaged by their rows.

    Averages are made by slices of the network, so that one network reaches the driver, however many tasks there are.
    """
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((net, state))

    def average(batches):
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for b in batches:
            for k, n, v in zip(*(b.column(c).to_pylist() for c in ("slice", "n", "v"))):
                sums[k] = sums.get(k, 0) + n * np.frombuffer(v, np.float32).astype(float)
                counts[k] = counts.get(k, 0) + n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(counts.values()), pa.int64()),
                                              pa.array([(sums[k] / counts[k]).astype(np.float32).tobytes() for k in sums], pa.binary())], ["slice", "n", "v"])

    # sorted by slice, so that the order of the sum, and with it the result, is that of the weights and bytes
    even = [sum(sizes.values()) / (2 * sizes[k]) for k in (0, 1)]
    parts = _networks(rows, sent, even).repartition("slice").sortWithinPartitions("slice", "n", "v")
    got = {r["slice"]: r["v"] for r in parts.mapInArrow(average, "slice int, n long, v binary").collect()}
    if got:
        net.take(np.frombuffer(b"".join(got[k] for k in sorted(got)), np.float32))
    sent.unpersist()


def _calibrate(rows: DataFrame, net: Cnn) -> None:
    """The thresholds from all rows, as counts by language, label and place of the logit."""
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((net, net.tables()))

    def count(batches):
        model, table = sent.value
        for b in batches:
            y = b.column("y").to_numpy().astype(np.int64)
            for i, j, data, ends in K.pieces(*K.texts(b.column("text")), PIECE):
                t = Text(data, ends)
                place = np.clip(np.floor(model.logits(t, table) * PLACES), -FAR, FAR).astype(np.int64)
                some, n = np.unique(np.stack([t.language, y[i:j], place]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in some), pa.array(n, pa.int64())], ["language", "y", "place", "n"])

    got = rows.mapInArrow(count, "language long, y long, place long, n long").groupBy("language", "y", "place").agg(F.sum("n").alias("n"))
    got = got.toPandas().sort_values(["place", "y", "language"])
    if len(got):
        n = got["n"].to_numpy(float)
        net.calibrate((got["place"].to_numpy() + 0.5) / PLACES, got["y"].to_numpy(float), n, got["language"].to_numpy(), n)
    sent.unpersist()


def score(docs: DataFrame, net, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the calibrated probability, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast((net, net.tables()))

    def make():
        model, table = sent.value
        return lambda data, ends: [model.probability(Text(data, ends), table).astype(float)]

    return annotate(docs, text_col, make, [(name, "double")], PIECE)


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.5, mod: int = 5, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    A null text counts as empty and gets the score of an empty text; a null id is never held out; repeated
    rows each give a row; further columns are ignored.  Null labels are ignored, the larger of conflicting
    ones counts; without both labels every score is the smoothed share of label 1.  Tables may be empty.
    """
    net = train(docs, labels, label_col, mod, text_col, id_col)
    out = score(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), net)
    return out.select("doc_id", F.coalesce(fold("doc_id", mod) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
