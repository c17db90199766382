"""Operator 13 against a brute force in Python integers, and its bounds against full scans."""
import hashlib
import math
import random
from collections import defaultdict

import numpy as np

from noteweave.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def brute(rows, rounds=V.ROUNDS):
    """{(vec_id, position in rows): (code, error, label_error)} and the digest, all entries scanned every time."""
    kept = [(i, e, k, lab) for k, (i, e, lab, *_) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = -(-max((len(e) for _, e, *_ in kept), default=0) // 8)
    whole = {k: [math.floor(4096 * np.float32(x).item()) for x in e] + [0] * (8 * width - len(e)) for _, e, k, _ in kept}
    part = lambda k, p: whole[k][p * width: (p + 1) * width]
    least = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[part(k, p) for _, _, k, _ in least] for p in range(8)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        code = {(k, p): min(range(len(books[p])), key=lambda e: (square(part(k, p), books[p][e]), e)) for k in whole for p in range(8)}
        if r == rounds:
            break
        for p in range(8):
            for e in range(len(books[p])):
                own = [part(k, p) for k in whole if code[k, p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    error = {k: sum(square(part(k, p), books[p][code[k, p]]) for p in range(8)) for k in whole}
    total = defaultdict(int)
    for _, _, k, lab in kept:
        total[lab] += error[k]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join("%02x" % code[k, p] for p in range(8)), error[k], total[lab], digest) for i, _, k, lab in kept)


def got(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def vectors(n, dim, seed, grid=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        e = [rng.choice(grid) if grid else rng.gauss(0, 0.3) + (i % 5) for _ in range(dim)]
        rows.append((1000 - 3 * i, e, rng.choice([None, 1, 2]), "x", 1))
    return rows


def test_rounds_by_brute_force(spark):
    rows = vectors(150, 16, 1)
    rows += [(7, None, 1, "x", 1), (8, [float("nan")] * 16, 1, "x", 1), (9, [None] + [1.0] * 15, 1, "x", 1), (10, [float("inf")] + [0.0] * 15, 1, "x", 1)]
    rows += [rows[3], rows[3], (None, [0.5] * 16, None, "x", 1), (5, [-0.0001] * 16, 2, "x", 1), (6, [0.0] * 16, 2, "x", 1), (1000, [9.0] * 16, 1, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert got(V.vector_codes(df)) == brute(rows)


def test_ties_and_few_rows(spark):
    ties = vectors(120, 8, 2, grid=[0.0, 1 / 4096, 2 / 4096])
    assert got(V.vector_codes(spark.createDataFrame(ties, SCHEMA).repartition(3))) == brute(ties)
    few = vectors(5, 12, 3)  # a length that 8 does not divide, fewer rows than entries
    assert got(V.vector_codes(spark.createDataFrame(few, SCHEMA))) == brute(few)
    one = [(1, [0.25] * 8, None, "x", 1)] * 40
    assert got(V.vector_codes(spark.createDataFrame(one, SCHEMA))) == brute(one)


def test_odd_tables(spark):
    assert V.vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = vectors(40, 8, 4) + [(1, [1.0, 2.0], 1, "x", 1), (2, [], 1, "x", 1), (3, [1e30] * 8, None, "x", 1)]
    out = {r.vec_id: r for r in V.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == 43 and out[1].code is None and out[2].code is None and out[1].error is None and len(out[3].code) == 16 and out[3].error >= 0
    empty = [(i, [], 1, "x", 1) for i in range(20)]
    assert {(r.code, r.error) for r in V.vector_codes(spark.createDataFrame(empty, SCHEMA)).collect()} == {("00" * 8, 0)}


def test_bounds_never_change_a_code_and_save_most_scans():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(200 * c, 6, (300, 8, 4)) for c in range(16)]).astype(np.int32)
    books, moved = x[:: 300].transpose(1, 0, 2), 0.0
    history, state, scans = books[None], V.Bounds.fresh(len(x)), []
    for r in range(7):
        _, n = state.assign(x, history)
        d = x[:, :, None].astype(np.int64) - history[-1].astype(np.int64)
        square = (d * d).sum(axis=3)
        assert np.array_equal(state.code, square.argmin(axis=2))
        net, others = V.net_moves(history)
        own = np.sqrt(np.take_along_axis(square, state.code[..., None].astype(int), 2)[..., 0].astype(float))
        i, p = np.arange(len(x))[:, None], np.arange(8)
        assert (state.upper + net[state.stamps[..., 0], p, state.code] >= own).all()
        rest = square.astype(float)
        rest[i, p, state.code] = np.inf
        assert (state.lower - others[state.stamps[..., 1], p, state.code] <= np.sqrt(rest.min(axis=2))).all()
        scans.append(n)
        drift = np.rint(rng.normal(0, 3, history[-1].shape)) * (1 if r % 2 else -1)
        history = np.concatenate([history, (history[-1] + drift).astype(np.int32)[None]])
    assert scans[0] == len(x) * 8 and max(scans[1:]) < scans[0] / 20


def test_net_moves_are_no_longer_than_summed_moves():
    rng = np.random.default_rng(6)
    history = np.cumsum(rng.integers(-9, 10, (7, 8, 16, 4)), axis=0).astype(np.int32)
    net, _ = V.net_moves(history)
    steps = np.sqrt((np.diff(history.astype(float), axis=0) ** 2).sum(axis=-1))
    summed = np.concatenate([np.cumsum(steps[::-1], axis=0)[::-1], np.zeros((1, 8, 16))])
    assert (net <= summed * (1 + 1e-9)).all() and net[:5].sum() < 0.9 * summed[:5].sum()
