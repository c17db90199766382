"""Operator 2: text scores of a hashed maximum-entropy model with a class-factored softmax.

P(token | text before it) = P(group of its class | features) x P(class | group, features)
x P(token | its class, the word before).

Classes: the most frequent words have one each, so has the end of a text; every other
word, known or not, falls into a class by its last bytes.  Inside a class a word's
probability is its discounted count, and the discounts together are the probability of
an unknown word there; so everything sums to 1 over known words and one unknown word a
class.  That share is the prior of the word's share among the words of its class that follow
the word before it, counted over all training texts; so these counts grow with the corpus,
while the softmax over the classes has a fixed size.  The features of a token are the word before it, the two words before it (n-grams)
and skips (the second word before alone, the third and the first), hashed to a fixed
number of rows of weights.

Counts come from all training texts: shards send their distinct words, and then their
distinct pairs of words, to partitions of the hashes and get the totals back.  Weights are trained in one pass over all
training texts in a few rounds; in each, tasks take gradient steps on their texts, and
their updates are averaged, row by row, in as many stripes as there are.  Texts are
scored in batches of tokens that gather only the rows their features name.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .bwt_dedup import large as from_40_bits
from .bwt_dedup import small as to_40_bits
from .common import release, shared_dir, stored
from .shards import SHARD_BYTES, Shards, bytes_to_rows, pack, unpack

U64 = np.uint64
#: Classes: so many of frequent words, then by the last bytes, then the end of a text.
FREQUENT, ENDINGS = 39, 24
CLASSES = FREQUENT + ENDINGS + 1
END_CLASS = CLASSES - 1
LAST_BYTES = 3
#: The 64 classes are 8 groups of 8: two softmaxes of 8 in place of one of 64.
GROUPS = 8
ROWS = 1 << 15
STRIPE = 1 << 10
ROUNDS, STEP, RATE = 3, 16384, 0.2
#: Tokens that the class's own shares count for against those seen after the word before.
PRIOR = 4.0
#: Text bytes that a partition of the vocabulary stands for, at most.
PARTITION_BYTES = 64 << 20
PIECE = 1 << 19
START = U64(0x243F6A8885A308D3)


class Vocabulary(NamedTuple):
    """What the counts of all training texts come to; bounded, whatever the corpus."""

    tokens: int  # training tokens, ends included
    distinct: int
    texts: int  # training texts, that is ends
    frequent: np.ndarray  # hashes of the words with classes of their own, ascending
    frequent_class: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    discount: np.ndarray

    def classes(self, words: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = FREQUENT + ending.astype(np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
            out = np.where(self.frequent[at] == words, self.frequent_class[at], out)
        return out


def held_out(ids: list, mod: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % mod == 0 for i in ids], bool)


class Tokens:
    """Words of some texts: hash, class by ending, text; and their number by text."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        data = K.LOWER[data]
        starts, stops, self.text = K.words(data, ends, K.NOT_SPACE)
        self.word = K.span_hashes(data, starts, stops)
        self.ending = (K.span_hashes(data, np.maximum(starts, stops - LAST_BYTES), stops, 5) % U64(ENDINGS)).astype(np.uint8)
        self.count = K.count_by_text(self.text, len(ends))

    def sequence(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """With an end after each text: (place of the word or -1, text, place in its text)."""
        n = self.count + 1
        text = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        source = np.full(len(text), -1)
        source[place < self.count[text]] = np.arange(len(self.word))
        return source, text, place


def features(word: np.ndarray, place: np.ndarray) -> np.ndarray:
    """[tokens, 4] hashes of the n-grams and skips before each token."""
    def back(k):
        out = np.full(len(word), START + U64(k))
        if k < len(word):
            out[k:] = word[:-k]
        out[place < k] = START
        return out

    a, b, c = back(1), back(2), back(3)
    prime = U64(0x9E3779B97F4A7C15)
    return np.stack([K.mix(a + U64(1)), K.mix(a * prime + K.mix(b) + U64(2)), K.mix(b + U64(3)), K.mix(a * prime + K.mix(c) + U64(4))], axis=1)


def rows_of(hashes: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """[5, tokens] rows of weights of a softmax: its own constant row, and the hashed features'."""
    if group is None:
        first = np.zeros(len(hashes), np.int64)
    else:
        first = group
        hashes = K.mix(hashes + (group.astype(U64) + U64(1))[:, None])
    return np.concatenate([first[None], GROUPS + (hashes % U64(ROWS - GROUPS)).astype(np.int64).T])


def scores_of(table: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[GROUPS, tokens] sums of the rows, the largest of a token put at 0; and the logarithm of the sum of their exponentials."""
    z = table.take(rows[0], axis=0)
    for r in rows[1:]:
        z += table.take(r, axis=0)
    z = np.ascontiguousarray(z.T)  # operations along tokens are much faster than along eight numbers
    z -= z.max(axis=0)
    e = np.exp(z)
    while len(e) > 1:
        e = e[::2] + e[1::2]
    return z, np.log(e[0])


def class_log_probability(weights: np.ndarray, hashes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """``weights`` is [2, ROWS, GROUPS]: of the groups, and of the classes in a group."""
    group, member, at = kind // GROUPS, kind % GROUPS, np.arange(len(kind))
    (z, total), (inner, inner_total) = scores_of(weights[0], rows_of(hashes)), scores_of(weights[1], rows_of(hashes, group))
    return (z[group, at] - total) + (inner[member, at] - inner_total)


class Learner:
    """Gradient steps (Adagrad) from given weights, and how often each row was used."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.copy()
        self.squares = np.full(weights.shape, 1e-2, np.float32)
        self.uses = np.zeros(weights.shape[:2], np.int64)

    def learn(self, hashes: np.ndarray, kind: np.ndarray) -> None:
        group, member = kind // GROUPS, kind % GROUPS
        for n, (rows, target) in enumerate(((rows_of(hashes), group), (rows_of(hashes, group), member))):
            z, total = scores_of(self.weights[n], rows)
            g = np.exp(z - total)
            g[target, np.arange(len(target))] -= 1
            used = rows.T.ravel()
            step = np.stack([np.bincount(used, np.repeat(x, len(rows)), ROWS) for x in g], axis=1)
            step = (step / np.sqrt(len(target))).astype(np.float32)
            self.squares[n] += step * step
            self.weights[n] -= np.float32(RATE) * step / np.sqrt(self.squares[n])
            self.uses[n] += np.bincount(used, minlength=ROWS)


def token_stream(rows: pa.RecordBatch, vocabulary: Vocabulary, keep: np.ndarray | None = None):
    """For runs of whole texts: (first text, tokens, sequence's word place, text, place, class, feature words)."""
    data, ends = K.texts(rows.column("text"))
    for i, j, part, part_ends in K.pieces(data, ends, PIECE):
        if keep is not None and not keep[i:j].any():
            continue
        t = Tokens(part, part_ends)
        source, text, place = t.sequence()
        word = np.where(source >= 0, t.word[source] if len(t.word) else START, START)
        kind = np.full(len(source), END_CLASS)
        kind[source >= 0] = vocabulary.classes(t.word, t.ending)
        yield i, j, t, source, text, place, kind, word


def count_message(rows: pa.RecordBatch, parts: int, mod: int):
    """Distinct words of a shard, with their counts in its training texts and classes by ending, for each partition."""
    data, ends = K.texts(rows.column("text"))
    train = ~held_out(rows.column("doc_id").to_pylist(), mod)
    words, n, endings = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    for i, j, part, part_ends in K.pieces(data, ends):
        t = Tokens(part, part_ends)
        u, first, inverse = np.unique(t.word, return_index=True, return_inverse=True)
        words.append(u)
        n.append(np.bincount(inverse, train[i:j][t.text], len(u)).astype(np.int64))
        endings.append(t.ending[first])
    words, n, endings = np.concatenate(words), np.concatenate(n), np.concatenate(endings)
    u, first, inverse = np.unique(words, return_index=True, return_inverse=True)
    n, endings = np.bincount(inverse, n, len(u)).astype(np.int64), endings[first]
    part = ((u >> U64(32)) * U64(parts)) >> U64(32)
    cuts = np.searchsorted(part, np.arange(parts + 1).astype(U64))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            own = slice(cuts[p], cuts[p + 1])
            yield p, pack(u[own], n[own].astype(np.uint32) if n[own].max() < 1 << 32 else n[own], endings[own])


def count_answer(messages: list[bytes]):
    """Total of each word asked for; the first sender also gets the partition's statistics."""
    got = [unpack(m) for m in messages]
    u, inverse = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    n = np.bincount(inverse, np.concatenate([g[1] for g in got]), len(u)).astype(np.int64)
    ending = np.zeros(len(u), np.uint8)
    ending[inverse] = np.concatenate([g[2] for g in got])
    known = n > 0
    stats = np.stack([np.bincount(ending, w, ENDINGS) for w in (n, known, n == 1, n == 2)]).astype(np.int64)
    top = np.lexsort((u, -n))[:FREQUENT]
    top = top[n[top] > 0]
    at = 0
    for k, g in enumerate(got):
        own = n[inverse[at: at + len(g[0])]]
        at += len(g[0])
        extra = (stats.ravel(), u[top], n[top], ending[top]) if k == 0 else ()
        yield pack(own, *extra)


def by_partition(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each key; ascending if the keys are."""
    return ((keys >> U64(32)) * U64(parts)) >> U64(32)


def pair_keys(word: np.ndarray, place: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that share their class; of each, hashes of (word before, class, word) and (word before, class)."""
    before = np.full(len(word), START)
    before[1:] = word[:-1]
    before[place < 1] = START
    own = np.flatnonzero((kind >= FREQUENT) & (kind != END_CLASS))
    context = K.mix(K.mix(before[own] + U64(6)) + kind[own].astype(U64))
    return own, K.mix(context * U64(0x9E3779B97F4A7C15) + word[own]), context


def counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their sums."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def inverse(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the place of each key in them."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return keys[new], at


def small(n: np.ndarray) -> np.ndarray:
    return n.astype(np.min_scalar_type(int(n.max(initial=0))))


def pair_counts(rows: pa.RecordBatch, v: Vocabulary, mod: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a shard's pairs and contexts, with their counts in its training texts."""
    train = ~held_out(rows.column("doc_id").to_pylist(), mod)
    keys, n = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for i, j, _, _, text, place, kind, word in token_stream(rows, v):
        own, pair, context = pair_keys(word, place, kind)
        u, c = counted(np.concatenate([pair, context]), np.tile(train[i:j][text[own]], 2).astype(np.int64))
        keys.append(u)
        n.append(c)
    return (keys[1], n[1]) if len(keys) == 2 else counted(np.concatenate(keys), np.concatenate(n))


def pair_message(rows: pa.RecordBatch, v: Vocabulary, parts: int, mod: int):
    """The keys, 40 bits of each within its partition, and their counts."""
    u, n = pair_counts(rows, v, mod)
    cuts = np.searchsorted(by_partition(u, parts), np.arange(parts + 1).astype(U64))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            yield p, pack(to_40_bits(u[cuts[p]: cuts[p + 1]]), small(n[cuts[p]: cuts[p + 1]]))


def pair_answer(messages: list[bytes]):
    """Total of each key asked for."""
    got = [(from_40_bits(keys), n) for keys, n in map(unpack, messages)]
    u, n = counted(np.concatenate([g[0] for g in got]), np.concatenate([g[1].astype(np.int64) for g in got]))
    for g in got:
        yield pack(small(n[np.searchsorted(u, g[0])]))


def inside_class(share: np.ndarray, pair: np.ndarray, context: np.ndarray) -> np.ndarray:
    """P(token | class, word before) from its share of the class and the counts of the pair and of its context."""
    return (pair + PRIOR * share) / (context + PRIOR)


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    def run(batches):
        out = []
        for b in batches:
            for answers in b.column("answers").to_pylist():
                for a in answers:
                    own = unpack(a["message"])
                    if len(own) > 1:
                        out.append(pack(*own[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["stats"])

    def add(batches):
        stats, top = np.zeros(4 * ENDINGS, np.int64), []
        for b in batches:
            for m in b.column("stats").to_pylist():
                s, u, n, e = unpack(m)
                stats += s
                top += list(zip(n.tolist(), u.tolist(), e.tolist()))
                top = sorted(top, key=lambda x: (-x[0], x[1]))[:FREQUENT]
        cols = [np.array(c, t) for c, t in zip(zip(*top), (np.int64, U64, np.uint8))] if top else [np.zeros(0, t) for t in (np.int64, U64, np.uint8)]
        yield pa.RecordBatch.from_arrays([pa.array([pack(stats, cols[1], cols[0], cols[2])], pa.binary())], ["stats"])

    some = counts.select("answers").mapInArrow(run, "stats binary").mapInArrow(add, "stats binary")
    stats, top = np.zeros(4 * ENDINGS, np.int64), []
    for r in some.toLocalIterator():  # about a kilobyte from each task
        s, u, n, e = unpack(r.stats)
        stats += s
        top += list(zip(n.tolist(), u.tolist(), e.tolist()))
        top = sorted(top, key=lambda x: (-x[0], x[1]))[:FREQUENT]
    stats = stats.reshape(4, ENDINGS)
    tokens, words, ones, twos = (np.concatenate([np.zeros(FREQUENT, np.int64), s, np.zeros(1, np.int64)]) for s in stats)
    for k, (n, _, e) in enumerate(top):  # out of the class by ending, into one of its own
        for have, value in ((tokens, n), (words, 1), (ones, n == 1), (twos, n == 2)):
            have[FREQUENT + e] -= value
            have[k] += value
    tokens[END_CLASS], words[END_CLASS] = texts, int(texts > 0)
    by_hash = sorted(range(len(top)), key=lambda k: top[k][1])
    discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.9)
    return Vocabulary(int(tokens.sum()), int(words.sum()), texts, np.array([top[k][1] for k in by_hash], U64), np.array(by_hash, np.int64), tokens, words, discount)


def first_weights(v: Vocabulary) -> np.ndarray:
    """Nothing but the classes' shares, in the constant rows."""
    out = np.zeros((2, ROWS, GROUPS), np.float32)
    share = (v.class_tokens + 0.1).reshape(GROUPS, -1)
    out[0, 0] = np.log(share.sum(axis=1) / share.sum())
    out[1, :GROUPS] = np.log(share / share.sum(axis=1, keepdims=True))
    return out


def train(shards: Shards, v: Vocabulary, mod: int, folder: str) -> np.ndarray:
    """One pass over all training texts in ROUNDS rounds of averaged updates."""
    spark = shards.spark
    weights = first_weights(v)
    tasks = spark.sparkContext.defaultParallelism
    for n in range(ROUNDS):
        sent = spark.sparkContext.broadcast(weights)

        def learn(batches, sent=sent):
            learner = Learner(sent.value)
            for b in batches:
                for raw in b.column("rows").to_pylist():
                    rows = bytes_to_rows(raw)
                    use = ~held_out(rows.column("doc_id").to_pylist(), mod)
                    for i, j, _, _, text, place, kind, word in token_stream(rows, v, use):
                        at, own = features(word, place), np.flatnonzero(use[i:j][text])
                        for k in range(0, len(own), STEP):
                            some = own[k: k + STEP]
                            learner.learn(at[some], kind[some])
            change = ((learner.weights - sent.value) * learner.uses[:, :, None]).reshape(-1, STRIPE * GROUPS)
            for k, (part, uses) in enumerate(zip(change.astype(np.float32), learner.uses.reshape(-1, STRIPE))):
                if uses.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(part, uses)], pa.binary())], ["stripe", "change"])

        def average(batches):
            total: dict[int, list[np.ndarray]] = {}
            for b in batches:
                for k, data in zip(b.column("stripe").to_pylist(), b.column("change").to_pylist()):
                    part, uses = unpack(data)
                    have = total.setdefault(k, [np.zeros(STRIPE * GROUPS), np.zeros(STRIPE, np.int64)])
                    have[0] += part
                    have[1] += uses
            for k, (part, uses) in total.items():
                mean = part.reshape(STRIPE, GROUPS) / np.maximum(uses, 1)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], ["stripe", "change"])

        turn = shards.table.filter(F.pmod(F.xxhash64("shard"), F.lit(ROUNDS)) == n).select("rows").coalesce(tasks)
        kind = "stripe int, change binary"
        new = stored(turn.mapInArrow(learn, kind).repartition(2 * ROWS // STRIPE, "stripe").mapInArrow(average, kind), folder, f"round-{n}")
        flat = weights.copy().reshape(-1, STRIPE, GROUPS)
        for r in new.toLocalIterator():  # the weights themselves, whose size is fixed
            flat[r.stripe] += np.frombuffer(r.change, np.float32).reshape(STRIPE, GROUPS)
        weights = flat.reshape(weights.shape)
        release(spark)
    return weights


def text_scores(rows: pa.RecordBatch, answers: dict, pair_answers: dict, v: Vocabulary, weights: np.ndarray, parts: int, mod: int):
    """(n_tokens, n_known, base score, score) of each text."""
    pieces = list(token_stream(rows, v))  # a shard's texts are split into words once
    asked, word_at = inverse(np.concatenate([np.zeros(0, U64), *(x[2].word for x in pieces)]))
    totals = np.concatenate([np.zeros(0, np.int64), *(answers[p][0] for p in np.unique(by_partition(asked, parts)).tolist())]).astype(np.int64)[word_at]
    pairs = [pair_keys(word, place, kind) for _, _, _, _, _, place, kind, word in pieces]
    met, met_at = inverse(np.concatenate([np.zeros(0, U64), *(k for _, pair, context in pairs for k in (pair, context))]))
    seen = np.concatenate([np.zeros(0, np.int64), *(pair_answers[p][0].astype(np.int64) for p in np.unique(by_partition(met, parts)).tolist())])[met_at]
    size, words_done, met_done = len(rows), 0, 0
    n_tokens, n_known, base, score = (np.zeros(size, t) for t in (np.int64, np.int64, float, float))
    unit = np.log10(v.tokens + 0.1 * (v.distinct + 1))
    for (i, j, t, source, text, place, kind, word), (some, pair, context) in zip(pieces, pairs):
        c = np.full(len(source), v.texts)
        c[source >= 0] = totals[words_done: words_done + len(t.word)]
        words_done += len(t.word)
        own = np.arange(i, j)
        n_tokens[own] = np.bincount(text, minlength=j - i)
        n_known[own] = np.bincount(text, c > 0, j - i).astype(np.int64)
        base[own] = np.bincount(text, np.log10(c + 0.1) - unit, j - i)
        # inside its class: the discounted count, or all the discounts for a word not known; then what follows the word before
        single = (kind < FREQUENT) | (kind == END_CLASS)
        mass = np.where(c > 0, c - v.discount[kind], v.discount[kind] * v.class_words[kind])
        inside = np.where(single | (v.class_tokens[kind] == 0), 1.0, mass / np.maximum(v.class_tokens[kind], 1))
        n = len(some)
        inside[some] = inside_class(inside[some], seen[met_done: met_done + n], seen[met_done + n: met_done + 2 * n])
        met_done += 2 * n
        total = np.log10(inside)
        at = features(word, place)
        for k in range(0, len(at), STEP):
            total[k: k + STEP] += class_log_probability(weights, at[k: k + STEP], kind[k: k + STEP]) / np.log(10)
        score[own] = np.bincount(text, total, j - i)
    return n_tokens, n_known, base, score


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Words are lower-cased (A-Z) runs without white space, identified by 64-bit hashes; the end of a text is a
    token.  Rows whose crc32(id as text) mod ``mod`` is 0 are held out, all others train; a null id trains.
    A null text is empty (its end remains); repeated rows count each time; further columns are ignored; an
    empty table gives an empty result, and without training texts base and model know nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    trains = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != 0, F.lit(True))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.sum(trains.cast("long")).alias("texts")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total.n or 0) // PARTITION_BYTES))
    folder = shared_dir(spark)
    shards = Shards(rows, "text", folder, parts, shard_bytes)
    counts = shards.ask("counts", [], lambda batch, _: count_message(batch, parts, mod), count_answer)
    v = vocabulary(counts, total.texts or 0)
    pairs = shards.ask("pairs", [], lambda batch, _: pair_message(batch, v, parts, mod), pair_answer)
    weights = train(shards, v, mod, folder)
    sent = spark.sparkContext.broadcast((v, weights))

    def make(batch, answers):
        n_tokens, n_known, base, score = text_scores(batch, answers[0], answers[1], *sent.value, parts, mod)
        ids = batch.column("doc_id")
        return pa.RecordBatch.from_arrays([ids, pa.array(held_out(ids.to_pylist(), mod)), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(ids), sent.value[0].tokens)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return shards.finish([counts, pairs], make, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
