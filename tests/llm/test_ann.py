"""Operator 5: recall and scores against brute force."""
import numpy as np
import pytest

from noteweave.llm import ann


def exact(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def compare(got, want, least):
    have = {}
    for r in got:
        have.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q, truth in want.items():
        own = sorted(have.get(q, []))
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and len(own) == len(truth)
        assert own == sorted(own, key=lambda r: (-r[2], r[1]))
        scores = dict(truth)
        assert all(abs(s - scores[v]) < 1e-9 for _, v, s in own if v in scores)
        hit += len({v for _, v, _ in own} & scores.keys())
        total += len(truth)
    assert have.keys() <= want.keys() and hit >= least * total, hit / total


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    compare(ann.neighbours(df).collect(), exact(rows, 20, 20), 0.9)


@pytest.mark.parametrize("block", [4096, 5])
def test_copies_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BIN", block)
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    rng = np.random.default_rng(block)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 420)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [float("inf")] * 8), (1080, [None] + [1.0] * 7), (1100, [1.0]), (1120, []), (None, [2.0] * 8), (0, [9.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, score int")
    compare(ann.neighbours(df).collect(), exact([(i, min(v, [9.0] * 8) if i == 0 else v) for i, v in rows], 20, 20), 0.9)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.neighbours(df).collect())
    assert got == [(0, 1, 20, 4.0), (0, 2, 3, -1.0), (20, 1, 0, 4.0), (20, 2, 3, -2.0)]
    assert ann.neighbours(df.limit(0)).collect() == [] and ann.neighbours(df.filter("vec_id = 3")).collect() == []


def test_outliers_beside_tight_clusters(spark):
    # 3,000 queries find all neighbours, their copies, in the first leaf; the few scattered ones do not all
    rng = np.random.default_rng(3)
    x = np.r_[np.repeat(rng.normal(size=(30, 6)), 100, axis=0), rng.standard_t(1.5, size=(2000, 6))]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    ids = np.r_[20 * np.arange(3000), 100_001 + 20 * np.arange(1960), 200_000 + 20 * np.arange(40)]
    got = ann.neighbours(spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), "vec_id long, embedding array<double>")).toPandas()
    assert got.groupby("query_id").size().reindex(ids[ids % 20 == 0], fill_value=0).eq(20).all()
