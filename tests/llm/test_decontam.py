"""Operator 4 against brute force, with few and many blocks."""
import hashlib
import random
import re

import pytest

from noteweave.llm import decontam


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k:k + size]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k:k + n])) in wins:
                    hit |= set(range(k, k + n))
                    ids |= {str(i) for i in wins[x] if i is not None}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def data(seed):
    rng = random.Random(seed)
    vocab = ["The", "of", "é", "und"] + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 4, 9, 10, 11, 25])))) for i in range(40)] + [(3, "The of The"), (7, None), (None, "w1, w2 w3-w4")]
    docs = []
    for d in range(120):
        w = rng.choices(vocab, k=rng.choice([0, 3, 50, 200]))
        for _ in range(rng.choice([0, 0, 1, 3])):
            t = words(rng.choice(items)[1])
            at, cut = rng.randrange(len(w) + 1), rng.choice([0, 0, 0, 1])
            w[at:at] = [x.upper() if x.isascii() else x for x in t[cut:]]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    return docs + [(1000, None), (1000, None), (None, "x"), (1001, "The the of THE " * 20_000)], items


@pytest.mark.parametrize("block", [100_000, 60])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(decontam, "AT_ONCE", 1 << (18 if block > 60 else 6))
    docs, items = data(block)
    got = decontam.digest(decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_spans_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d", "mine"), (2, None, None)], "doc_id long, text string, items string")
    items = spark.createDataFrame([(5, "B c"), (6, "d")], "item_id long, text string")
    got = sorted(decontam.contamination(docs, items, names={"items": "found"}).collect())
    assert [(r.n_words, r.n_hit, [tuple(s) for s in r.spans], r.items, r.found) for r in got] == [(4, 3, [(1, 3)], "mine", ["5", "6"]), (0, 0, [], None, [])]
    assert decontam.contamination(docs.drop("items"), items.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontam.contamination(docs.drop("items").limit(0), items).collect() == []
