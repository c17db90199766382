"""Operator 9 against brute force, with chains, copies and blocks."""
import random
import re

import numpy as np
import pytest

from noteweave.llm import near_dup
from noteweave.llm.graph import components
from noteweave.llm.common import shared_dir


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    low = {i: i for i, _ in sets}
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= percent * len(x | y)]
    while True:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            return sorted((i, len(s), low[i], low[i] == i) for i, s in sets)


def run(spark, rows):
    return sorted(tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    base = [[rng.choice(["The", "of", "zé", "w%d" % rng.randrange(40)]) for _ in range(rng.choice([3, 40, 120, 300]))] for _ in range(n // 12)]
    rows = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(1000)
        rows.append((rng.randrange(10**12), rng.choice([" ", "\n"]).join(w)))
    return rows


@pytest.mark.parametrize("block", [256, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = corpus(block, 240) + [(1, None), (2, ""), (3, "a"), (4, "A"), (5, " a "), (6, "a b"), (7, "same words again " * 3000), (8, "same words again " * 2999)]
    assert run(spark, rows) == brute(rows)


def test_chain_and_border(spark):
    words = [f"w{i}" for i in range(204)]
    rows = [(9 - k, " ".join([f"c{k}"] * (3 * k) + words[3 * k:])) for k in range(9)]
    assert run(spark, rows) == brute(rows)


def test_null_ids_repeats_and_empty(spark):
    t = "one two three four five six seven"
    got = run(spark, [(3, t), (3, t), (5, t)])
    assert got == [(3, 3, 3, True), (3, 3, 3, True), (5, 3, 3, False)]
    assert [tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame([(None, t, 1)], "doc_id long, text string, k1 int")).collect()] == [(None, 3, None, True)]
    assert run(spark, []) == []


def test_keys_meet_within_the_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 65536, (2000, near_dup.HASHES)).astype(np.uint16)
    b = a.copy()
    for row in b:  # 15 differences, as spread as they can be
        row[rng.permutation(near_dup.HASHES)[:15]] ^= 1
    assert (near_dup.signature_keys(a) == near_dup.signature_keys(b)).any(axis=1).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 5), (7, 7)]
    low = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a in low and b in low:
                low[a] = low[b] = min(low[a], low[b])
    got = components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark), "t").collect()
    assert {r.node: r.component for r in got} == low and len(got) == len(low)


@pytest.mark.parametrize("values", [1, 64, 1 << 20])
def test_blocks_compared_in_ranges_of_values(monkeypatch, values):
    monkeypatch.setattr(near_dup, "VALUES", values if values > 1 else 40)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 64, 60, dtype=np.uint64)) for _ in range(6)]
    sets += [np.sort(np.r_[s[:-3], rng.integers(0, 1 << 64, 3, dtype=np.uint64)]) for s in sets[:4]] + [np.array([0, (1 << 64) - 1], np.uint64), np.array([(1 << 64) - 1], np.uint64)]
    label = near_dup.linked(sets, None, 85)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            common = len(np.intersect1d(x, y))
            if 100 * common >= 85 * (len(x) + len(y) - common):
                assert label[i] == label[j]
    assert len(set(label.tolist())) == 8
