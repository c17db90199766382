"""Operator 7: held-out accuracy, and the scores of odd rows."""
import numpy as np

from noteweave.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.quality(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    held = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert len(held) > 30 and (held["predicted"] == held["quality"]).mean() > 0.95
    assert (got["predicted"] == (got["score"] >= 0.3)).all()


def test_odd_rows(spark):
    rows = [(i, ("WORD!! " if i % 2 else "word and ") * 30, "x") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (None, "word", "x"), (5, "same", "x"), (102, "a" * 400_000 + " b" * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(60)] + [(0, 1), (0, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = {(r.doc_id, k): r for k, r in enumerate(Q.quality(docs, labels).collect())}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    scores = {r.doc_id: r.score for r in got.values()}
    assert scores[100] == scores[101]
    flat = Q.quality(docs, labels.filter("quality = 1")).select("score").distinct().collect()
    assert len(flat) == 1 and flat[0].score > 0.9
    assert {r.score for r in Q.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.quality(docs.limit(0), labels).collect() == []


def test_features_do_not_depend_on_the_batch():
    texts = ["A bb a!! a!!", "", "x" * 50, "ein ein Wört 12"]
    vectors, index = np.ones((Q.BUCKETS, Q.DIM), np.float32), Q.index_vectors()

    def of(ts):
        raw = [t.encode() for t in ts]
        return Q.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]), vectors, index)

    assert np.allclose(of(texts), np.concatenate([of([t]) for t in texts]))
