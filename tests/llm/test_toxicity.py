"""Operator 8: held-out accuracy, gradients, and the scores of odd rows."""
import numpy as np

from noteweave.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = X.toxicity(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    held = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    toxic = held["toxic"] == 1
    assert held[toxic]["predicted"].mean() > 0.85 and held[~toxic]["predicted"].mean() < 0.02


def test_odd_rows(spark):
    rows = [(i, "the cat sat " * (i % 7) + "vile " * (i % 2) + f"and so on n{i % 50}", 1) for i in range(200)] + [(300, None, 1), (301, "", 1), (None, "vile vile", 1), (302, "calm words " * 40_000, 1), (3, "the cat", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    got = X.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    score = {r.doc_id: r.score for r in got}
    assert score[300] == score[301] < 0.5 and score[302] < 0.5
    assert {r.score for r in X.toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert X.toxicity(docs.limit(0), labels).collect() == []


def test_table_equals_network_and_gradient_descends():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["aa", "bbbbbb", "ccccccccc", "dd", "bbbbbx"], rng.integers(0, 30))).encode() for _ in range(40)]
    y = np.array([float(b"cc dd" in t) for t in texts])
    net, t = X.Cnn(), X.joined(texts)
    e = t.summed(net.embedding)
    direct = net.logit(net.pooled(t, [[e @ f[i] for i in range(len(f))] for f in net.filters])[0])
    assert np.allclose(direct, net.logits(t, net.tables()), atol=1e-4)
    assert np.allclose(direct, np.concatenate([net.logits(X.joined([x]), net.tables()) for x in texts]), atol=1e-4)
    loss = lambda: np.logaddexp(0, np.where(y > 0, -1, 1) * net.logits(t, net.tables())).mean()
    before = loss()
    net.fit(texts, y, np.ones(len(y)))
    assert loss() < 0.7 * before


def test_language_and_threshold():
    assert [X.LANGUAGES[k] for k in X.joined([s.encode() for s in ("The cat is on it", "le chat est dans la rue", "el gato y los perros", "der Hund und die Katze")]).language] == ["en", "fr", "es", "de"]
    assert X.joined([b"xyzzy", b""]).language.tolist() == [len(X.LANGUAGES)] * 2
    assert 2 < X.threshold(np.array([1.0, 2, 3, 4]), np.array([0, 0, 1, 1.0]), np.ones(4)) < 3


def test_all_labelled_rows_are_learnt_from(spark, monkeypatch):
    """With a small sample to start with, a word that only rows outside the sample hold is learnt, and thresholds count every calibration row."""
    monkeypatch.setattr(X, "PER_CLASS", 40)
    monkeypatch.setattr(X, "PART", 1500)
    rows = [(i, f"calm words of day n{i % 50} " + ("vile " if i % 2 else "kind "), i % 2) for i in range(6000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen = []
    real = X.Cnn.calibrate
    monkeypatch.setattr(X.Cnn, "calibrate", lambda net, z, y, w, language, n=None: (seen.append(0 if n is None else n.sum()), real(net, z, y, w, language, n))[1])
    first = X.train(docs, labels)
    # 80 rows in the sample, about 4,800 in training, 30 % of them for the thresholds
    assert 1200 < seen[0] < 1700
    again = X.train(docs, labels)
    assert np.array_equal(first.flat(), again.flat()) and np.array_equal(first.thresholds, again.thresholds)
    got = X.toxicity(docs, labels).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.held_out]) > 0.99


def test_counted_rows_calibrate_like_single_rows():
    z, y = np.array([0.5, 1.5, 2.5, 3.5]), np.array([0, 0, 1, 1.0])
    n, language = np.array([30.0, 2, 25, 9]), np.zeros(4, int)
    a, b = X.Cnn(), X.Cnn()
    a.calibrate(z, y, n, language, n)
    k = n.astype(int)
    b.calibrate(np.repeat(z, k), np.repeat(y, k), np.ones(k.sum()), np.repeat(language, k))
    assert np.array_equal(a.thresholds, b.thresholds)


def test_networks_that_leave_tasks_are_few(spark, monkeypatch):
    """However many parts there are, TASKS networks are shuffled, and they stand for all rows; labels are not broadcast."""
    from noteweave.llm import common as C

    monkeypatch.setattr(X, "TASKS", 2)
    monkeypatch.setattr(X, "PART", 30)
    docs = spark.createDataFrame([(i, f"calm vile n{i % 7}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    ids = C.labelled_ids(labels, "toxic", 5)
    rows = C.labelled_texts(docs, ids, 20)
    assert rows.rdd.getNumPartitions() == 20 and "BroadcastExchange" not in rows._jdf.queryExecution().toString()
    texts, y = [b"calm", b"vile"] * 4, np.array([0.0, 1] * 4)
    net = X.Cnn()
    sent = spark.sparkContext.broadcast((net, net.fit(texts, y, np.ones(8))))
    C.ship(spark)
    got = X._networks(rows, sent, [1.0, 1.0]).toPandas()
    assert got.groupby("slice").size().eq(2).all() and got[got["slice"] == 0]["n"].sum() == ids.count()
