"""Operator 2: counts and base score against brute force, probabilities that sum to 1, gain on held-out texts."""
import math
import re
import zlib
from collections import Counter

import numpy as np

from noteweave.llm import lm as L

SF = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def brute(rows):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i if i is not None else -1), out(i), len(w := words(t)), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, t in rows)


def run(spark, rows, **k):
    got = L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), **k).collect()
    return got, sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)


def test_counts_base_and_gain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got, plain = run(spark, rows)
    assert plain == brute(rows)
    held = [r for r in got if r.held_out]
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.4


def test_odd_rows_and_many_shards(spark):
    rows = [(i, "The cat sat on Ünder mat " * (i % 5) + f"w{i}") for i in range(60)] + [(None, "cat"), (61, None), (62, ""), (62, ""), (63, "a b " * 100_000)]
    assert run(spark, rows, shard_bytes=200)[1] == brute(rows)
    assert run(spark, [])[0] == []
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got, plain = run(spark, [(out, "only held out")])
    assert plain == brute([(out, "only held out")]) and math.isfinite(got[0].score)


def vocabulary(texts):
    data = "".join(texts).encode()
    t = L.Tokens(np.frombuffer(data, np.uint8), np.cumsum([len(x.encode()) for x in texts]))
    u, inverse, n = np.unique(t.word, return_inverse=True, return_counts=True)
    ending = np.zeros(len(u), np.uint8)
    ending[inverse] = t.ending
    message = L.pack(u, n.astype(np.uint32), ending)
    own = L.unpack(next(L.count_answer([message])))

    class Counts:
        def select(self, _):
            return self

        mapInArrow = lambda self, *_: self

        def toLocalIterator(self):
            return [type("R", (), {"stats": L.pack(*own[1:])})]

    return L.vocabulary(Counts(), len(texts)), u, n, ending


def test_probabilities_sum_to_one():
    v, u, n, ending = vocabulary(["the cat sat the end the cat %d" % i for i in range(80)])
    kind = v.classes(u, ending)
    assert v.tokens == n.sum() + 80 and v.distinct == len(u) + 1
    for c in set(kind.tolist()):
        own = kind == c
        if c < L.FREQUENT:
            assert own.sum() == 1 and v.class_words[c] == 1 and v.class_tokens[c] == n[own][0]
        else:
            assert v.class_tokens[c] == n[own].sum() and v.class_words[c] == own.sum()
            assert np.isclose(((n[own] - v.discount[c]) / v.class_tokens[c]).sum() + v.discount[c] * v.class_words[c] / v.class_tokens[c], 1)
    hashes = L.features(u[:20], np.arange(20))
    w = np.random.default_rng(0).normal(size=(2, L.ROWS, L.GROUPS)).astype(np.float32)
    total = sum(np.exp(L.class_log_probability(w, hashes, np.full(20, c))) for c in range(L.CLASSES))
    assert np.allclose(total, 1, atol=1e-5)


def test_learning_uses_the_words_before():
    rng = np.random.default_rng(0)
    word = rng.integers(1, 6, 20_000).astype(np.uint64)
    hashes, kind = L.features(word, np.arange(len(word))), np.r_[0, word[:-1].astype(int)] * 11
    learner = L.Learner(np.zeros((2, L.ROWS, L.GROUPS), np.float32))
    for k in range(0, len(word), 200):
        learner.learn(hashes[k: k + 200], kind[k: k + 200])
    assert L.class_log_probability(learner.weights, hashes, kind).mean() > -0.2


def test_words_of_a_class_follow_the_word_before(spark):
    # x and y fall into one class by their endings, and neither is among the frequent words
    frequent = " ".join(f"f{k}" for k in range(L.FREQUENT))
    texts = [" ".join(f"{a}q{k} {b}same" for k in range(25) for a, b in (("lef", f"x{k}"), ("rig", f"y{k}"))) + " " + " ".join([frequent] * 4) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts) if not L.held_out([i], 10)[0]]
    out = [i for i in range(100, 200) if L.held_out([i], 10)[0]][:2]
    right, wrong = (" ".join(f"lefq{k} {b}{k}same" for k in range(25)) for b in "xy")
    got = {r.doc_id: r.score for r in L.lm_scores(spark.createDataFrame([*rows, (out[0], right), (out[1], wrong)], "doc_id long, text string")).collect()}
    assert got[out[0]] > got[out[1]] + 10


def test_shares_after_a_word_sum_to_one():
    rng = np.random.default_rng(0)
    share, pair = rng.dirichlet(np.ones(30)), rng.integers(0, 4, 30)
    assert np.isclose(L.inside_class(share, pair, pair.sum()).sum(), 1) and np.allclose(L.inside_class(share, 0, 0), share)


def test_a_text_is_split_once_when_scored(monkeypatch):
    """Words, pairs and classes of a scored shard come from one pass over its texts; keys keep their totals."""
    import pyarrow as pa

    texts = ["the cat sat on the mat " * 3, "", "a dog sat", "the the cat"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    v = vocabulary(texts)[0]
    words = {p: L.unpack(next(L.count_answer([m]))) for p, m in L.count_message(rows, 2, 10)}
    pairs = {p: L.unpack(next(L.pair_answer([m]))) for p, m in L.pair_message(rows, v, 2, 10)}
    split = []
    real = L.Tokens
    monkeypatch.setattr(L, "Tokens", lambda data, ends: (split.append(len(ends)), real(data, ends))[1])
    n_tokens, n_known, _, score = L.text_scores(rows, words, pairs, v, L.first_weights(v), 2, 10)
    assert split == [4] and n_tokens.tolist() == [19, 1, 4, 4] and (n_known <= n_tokens).all() and np.isfinite(score).all()
    keys = np.array([7, 3, 7, 9], np.uint64)
    u, at = L.inverse(keys)
    assert u.tolist() == [3, 7, 9] and at.tolist() == [1, 0, 1, 2] and [len(x) for x in L.inverse(keys[:0])] == [0, 0]
