"""Operator 3 against brute force; the merge against a plain sort."""
import hashlib
import random

import numpy as np
import pytest

from noteweave.llm import bwt_dedup as B


def brute(rows, length=50):
    rows = [(d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, t in rows:
        if d is not None:
            for i in range(len(t) - length + 1):
                s = t[i:i + length]
                least[s] = min(least.get(s, d), d)
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        if d is not None:
            for i in range(len(t) - length + 1):
                if least[t[i:i + length]] < d:
                    gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = ["the ", "of ", "é", "Wort ", "ab", "\n"] + ["w%d " % i for i in range(60)]
    text = lambda k: "".join(rng.choices(vocab, k=k))
    shared = [text(rng.choice([8, 20, 60])) for _ in range(12)] + ["x" * 70, "ab" * 60, "The very common passage, which a third of all documents hold in full. "]
    rows = []
    for _ in range(n):
        parts = [text(rng.choice([0, 3, 30, 80])) for _ in range(rng.randrange(1, 4))] + [rng.choice(shared)[rng.choice([0, 0, 1, 5]):] for _ in range(rng.randrange(3))]
        rng.shuffle(parts)
        rows.append((rng.randrange(10**9), "".join(parts)))
    return rows + [(7, rows[0][1]), (8, rows[0][1]), (8, rows[1][1]), (9, None), (10, ""), (None, rows[0][1]), (11, "x" * 49), (12, "x" * 50), (13, "x" * 50), (14, rows[2][1] * 20)]


@pytest.mark.parametrize("limits", [B.Limits(), B.Limits(shard=2000, segment=333, merge=500, hot=2)])
def test_equals_brute_force(spark, limits):
    rows = corpus(limits.hot)
    got = B.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string"), limits).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_columns_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a" * 60, "k1"), (2, "b" + "a" * 60 + "c", "k2")], "doc_id long, text string, kept string")
    got = sorted(B.remove_repeats(df, names={"kept": "rest"}).collect())
    assert [(r.kept, bytes(r.rest), [tuple(s) for s in r.spans]) for r in got] == [("k1", b"a" * 60, []), ("k2", b"bc", [(1, 61)])]
    assert B.remove_repeats(df.drop("kept").limit(0)).collect() == []
    assert [bytes(r.kept) for r in B.remove_repeats(df.drop("kept"), length=3).orderBy("doc_id").collect()] == [b"a" * 60, b"bc"]


@pytest.mark.parametrize("length", [5, 6, 50])
def test_merge_orders_and_parts_suffixes(length):
    rng = np.random.default_rng(length)
    strings = [bytes(rng.choice(list(b"ab"), rng.integers(length, length + 20)).tolist()) for _ in range(60)]
    strings += [strings[0][:length] + b"xx", strings[3]]
    source = np.sort(rng.integers(0, 5, len(strings)))
    sizes = np.array([len(s) for s in strings])
    where, block, prefix = B.merged_intervals(np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8), sizes, source, length)
    begin = np.cumsum(sizes + 1) - sizes - 1
    turned = []
    for w in where:
        k = int(np.searchsorted(begin, w, "right")) - 1
        x = strings[k] + b"\xff"
        r = x[w - begin[k]:] + x[: w - begin[k]]
        turned.append((r * (length // len(r) + 1))[:length])
    assert turned == sorted(turned)
    for i in range(1, len(turned)):
        common = next((c for c in range(length) if turned[i][c] != turned[i - 1][c]), length)
        assert (block[i] == block[i - 1]) == (common == length)
        assert prefix[i] == (length if common == length else common // 2 * 2)


@pytest.mark.parametrize("length,alphabet", [(5, b"ab"), (50, b"ab"), (50, bytes(range(250)))])
def test_four_symbols_a_round_give_the_same_intervals(length, alphabet, monkeypatch):
    rng = np.random.default_rng(length)
    size = length + (4000 if len(alphabet) > 2 else 20)  # many symbols: too many different fours for 16 bits
    strings = [bytes(rng.choice(list(alphabet), rng.integers(length, size)).tolist()) for _ in range(60)]
    strings += [strings[0][:length] + b"xx", strings[3]]
    source = np.sort(rng.integers(0, 5, len(strings)))
    sizes = np.array([len(s) for s in strings])
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    rounds = []
    real = np.argsort
    monkeypatch.setattr(B.np, "argsort", lambda a, *x, **k: (rounds.append(a.dtype), real(a, *x, **k))[1])
    two = B.merged_intervals(text, sizes, source, length)
    n = rounds.count(np.dtype(np.uint16))
    rounds.clear()
    four = B.merged_intervals(text, sizes, source, length, 4)
    if len(alphabet) == 2:
        assert rounds.count(np.dtype(np.uint16)) < n
    assert np.array_equal(two[1], four[1])
    for k in np.unique(two[1])[:500]:
        assert sorted(two[0][two[1] == k]) == sorted(four[0][four[1] == k])
