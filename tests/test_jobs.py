"""Long labels, folded dictionary, span positions."""
import re

from noteweave.operators import jobs


def test_gazetteer_finds_labels_of_any_length_once(spark):
    docs = spark.createDataFrame([(1, "Acute pain of the left big toe, and Pain."), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([("C2", "pain of the left  big toe"), ("C1", "Pain of the left big toe"), ("C3", "pain"), ("C4", " ")], "cui string, label string")
    got = sorted(tuple(r) for r in jobs.gazetteer(docs, labels).collect())
    assert got == [(1, 6, 10, "pain", ["C3"]), (1, 6, 30, "pain of the left big toe", ["C1", "C2"]), (1, 36, 40, "Pain", ["C3"])]


def test_spans_of_a_long_text(spark):
    text = "É one. Two three? " * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.start_pos, r.end_pos) for r in jobs.sentence_spans(df).collect()]
    assert sorted(got) == [m.span() for m in re.finditer(jobs.SENTENCE_RE, text)]


def test_gazetteer_by_brute_force(spark):
    import random
    rnd = random.Random(5)
    words = ["pain", "of", "the", "left", "toe", "É", "x1"]
    texts = {i: "".join(rnd.choice(words).title() + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(60)) for i in range(40)} | {90: None, 91: ""}
    labels = [(f"C{k}", " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 8])))) for k in range(60)] + [("C99", None), ("C98", "Left-toe")]
    got = sorted(tuple(r) for r in jobs.gazetteer(spark.createDataFrame(list(texts.items()), "doc_id int, text string"),
                                                  spark.createDataFrame(labels, "cui string, label string")).collect())
    want = []
    for d, t in texts.items():
        found = [m.span() for m in re.finditer(jobs.WORD_RE, t or "", re.ASCII)]
        for i in range(len(found)):
            for n in range(1, 9):
                run = found[i:i + n]
                s = " ".join((t or "")[a:e] for a, e in run)
                cuis = sorted({c for c, lab in labels if lab is not None and lab.lower() == s.lower()})
                if len(run) == n and cuis:
                    want.append((d, run[0][0], run[-1][1], s, cuis))
    assert got == sorted(want)


def test_long_labels_cost_nothing_elsewhere(spark):
    """Labels of 60 and 200 words beside short ones: a text of 200,000 words gives candidates only where labels start."""
    import time
    long = [" ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(200))]
    labels = spark.createDataFrame([("A", long[0]), ("B", long[1]), ("C", "w1")], "cui string, label string")
    text = " ".join(f"w{k % 59}" for k in range(100_000)) + " " + long[0].upper() + " " + long[1] + " tail" * 100_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    t = time.time()
    got = [(r.cuis, len(r.str.split())) for r in jobs.gazetteer(docs, labels).collect()]
    assert time.time() - t < 30
    assert got.count((["A"], 60)) == 1 and got.count((["B"], 200)) == 1 and len(got) == 1695 + 2 + 1 and got.count((["C"], 1)) == len(got) - 2
