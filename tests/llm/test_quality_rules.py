"""Operator 11: rule counts against a brute force on whole texts, held-out accuracy, and a restatement of the scores."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from noteweave.llm import quality_rules as R

SF = "/root/testdata/sf0.01"


def brute_counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i: i + 8]) for i in range(len(words) - 7)]
    many, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            hit.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def counts(texts):
    raw = [(t or "").encode() for t in texts]
    out = R.rule_counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64))
    return list(zip(*(c.tolist() for c in out)))


def test_rule_counts_by_brute_force():
    rng = random.Random(1)
    parts = ["a", "bb", "é", "# x", "\n", "\n\n", "\r\n", " \t", "日本", "l1 l2", "\u0085", "<>|", "\x0b"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(120))) for _ in range(400)]
    texts += ["", None, "\n", "a\na\r\na\n", "x " * 9, "x " * 8, "w " * 50_000, "one\n\none\n" * 3, " ".join("abcdefgh") + " " + " ".join("abcdefgh")]
    rng.shuffle(texts)
    assert counts(texts) == [brute_counts(t) for t in texts]
    assert counts([]) == []


@pytest.fixture(scope="module")
def whole(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs.toPandas(), labels.toPandas(), R.quality_rules(docs, labels).toPandas()


def test_whole_table(whole):
    docs, labels, got = whole
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"]) and got["score"].between(0, 1).all()
    want = {i: brute_counts(t) for i, t in zip(docs["doc_id"], docs["text"])}
    for r in got.itertuples():
        c = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 20 or 100 * c[4] > 30 * c[0]) and r.kept == (not r.base_failed and r.score >= 0.3)
    held = got[got["held_out"] & ~got["base_failed"]].merge(labels, on="doc_id")
    assert (held["kept"] == (held["quality"] == 1)).mean() > 0.95


def test_odd_rows(spark):
    rows = [(i, ("WORD!! " if i % 2 else "word and ") * 15 + " ".join(f"t{i}x{k}" for k in range(30)), "x") for i in range(80)]
    rows += [(100, None, "x"), (101, "", "x"), (None, "word", "x"), (5, "same", "x"), (102, "a" * 400_000 + " b" * 200_000, "x"), (5, "same", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(80)] + [(0, 1), (0, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = R.quality_rules(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[100][1:] == (*by[101][1:8], by[100].held_out, by[101].score) and by[100].base_failed and not by[100].kept
    assert by[102].base_failed and by[102].n_repeat_words == 200_000
    flat = R.quality_rules(docs, labels.filter("quality = 1")).select("score").distinct().collect()
    assert len(flat) == 1 and flat[0].score > 0.9
    assert {r.score for r in R.quality_rules(docs, labels.limit(0)).collect()} == {0.5}
    assert R.quality_rules(docs.limit(0), labels).collect() == []


def plain_logit(text, model):
    """The n-grams of one text, one by one, each hashed on its own."""
    one = lambda t: np.frombuffer(t.encode(), np.uint8)
    total = model.bias
    folded = re.sub("[0-9]", "0", text)
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    for kind, grams in enumerate([[(w,) for w in words], list(zip(words, words[1:])), [folded[i: i + 3] for i in range(len(folded) - 2)], [folded[i: i + 4] for i in range(len(folded) - 3)]]):
        found = []
        for g in grams:
            data = one(" ".join(g) if kind < 2 else g)
            buckets = list(R.grams(data, np.array([len(data)])))[kind][0]
            found.append(model.weights[kind][buckets[0]])
        total += R.GAIN * sum(found) / max(len(found), 1)
    return total


def test_scores_by_plain_restatement():
    rng = np.random.default_rng(2)
    model = R.Model(rng.normal(size=(R.KINDS, R.BUCKETS)).astype(np.float32), 0.25)
    texts = ["", "a", "Ein Wört 12 und 12", "x x x y", "日本 語", "tab\tand\nline é", "ab"]
    raw = [t.encode() for t in texts]
    got = model.logits(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64))
    assert np.allclose(got, [plain_logit(t, model) for t in texts], atol=1e-4)
    flat = model.weights.ravel()
    for t, z in zip(raw, got):
        places, values = R.sparse(t)
        assert abs(z - model.bias - (flat[places] * values).sum()) < 1e-4


def test_fit_lowers_the_loss_and_platt_finds_the_sigmoid():
    texts = [f"good words here {i}" for i in range(40)] + [f"BAD!! BAD!! {i} zz" for i in range(40)]
    rows = [(*R.sparse(t.encode()), float(i < 40)) for i, t in enumerate(texts)]
    w, b = R.improve(rows, np.zeros(R.KINDS * R.BUCKETS), 0.0, np.full(R.KINDS * R.BUCKETS + 1, 1e-4), 0)
    z = np.array([(w[p] * v).sum() + b for p, v, _ in rows])
    assert (z[:40] > 0).all() and (z[40:] < 0).all()
    rng = np.random.default_rng(0)
    z = rng.normal(0, 3, 200_000)
    y = (rng.random(len(z)) < 1 / (1 + np.exp(-(0.7 * z - 1)))).astype(float)
    a, b = R.platt(z, y, np.ones(len(z)))
    assert abs(a - 0.7) < 0.02 and abs(b + 1) < 0.03
    assert R.platt(z, np.ones(len(z)), np.ones(len(z))) == (1.0, 0.0)


def test_calibration_reads_every_labelled_row_of_its_fourth(spark):
    """Far more labelled rows than the fit may take: the sigmoid comes from all of the fourth, none of it fitted."""
    scored = spark.range(30_000).selectExpr("id as doc_id", "cast(if(id % 3 = 0, 1, -1) + (id % 7) / 10 as double) as logit")
    labels = spark.range(30_000).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as quality")
    own = labels.filter(R.calibrating("doc_id")).filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").join(scored, "doc_id").toPandas()
    want = R.platt((own["logit"] * R.BINS).round().to_numpy() / R.BINS, own["quality"].to_numpy(float), np.ones(len(own)))
    assert np.allclose(R.calibration(scored, labels), want, rtol=1e-3) and 5000 < len(own) < 7000
