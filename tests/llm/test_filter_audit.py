"""Operator 12 against a brute force that applies the filters in all 120 orders, row by row."""
import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from noteweave.llm import filter_audit as A

DOCS = "doc_id long, text string, source string, kept string, step int"
LABELS = "doc_id long, quality int, toxic int, text string"


def brute(rows, labels):
    good = {i for i, q, _, _ in labels if q == 1}
    toxic = {i for i, _, t, _ in labels if t == 1}
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    facts = []
    for i, text, part, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        facts.append((part or "", {f for f, x in fails.items() if x}, i in good and i is not None, i in toxic and i is not None))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in facts}:
        own = [f for f in facts if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in own if f in r[1]]
                shapley[part, f] += len(gone)
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {k: v + (shapley[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def got(df):
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "string", "int"] + ["bigint"] * 7
    rows = df.collect()
    out = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_all_orders_by_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "Bb", "CCC", "w%d" % rng.randrange(200), "é\u0085", "x#", "y"]) for _ in range(rng.choice([3, 49, 50, 51, 90]))) for _ in range(60)]
    texts += [None, "", "\n \t", "A" * 60, " ".join("w%d" % i for i in range(50)), "q " * 30_000, "w%d " * 50]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "web", "book"]), "x", 7) for _ in range(300)]
    rows += [rows[0], rows[0], (5, "same", "web", "x", 1), (5, "same", "book", "x", 1), (5, "other", "web", "x", 1), (4, "same", "", "x", 1)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "t") for i in range(0, 45, 2)] + [(2, 1, 0, "t"), (2, 0, 1, "t"), (None, 1, 1, "t")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert got(A.audit(docs, spark.createDataFrame(labels, LABELS))) == brute(rows, labels)
    none = spark.createDataFrame([], LABELS)
    assert got(A.audit(docs, none)) == brute(rows, [])
    assert got(A.audit(docs.limit(0), none)) == {}


def test_one_text_in_a_third_of_all_rows(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i}", "web" if i % 2 else "book", "", 0) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    cells = {(r.part, r.bits): r.n for r in A.failure_counts(docs, spark.createDataFrame([(0, 1, 0, "")], LABELS)).collect()}
    assert sum(n for (_, b), n in cells.items() if b & 16) == 299 and sum(cells.values()) == 900


def test_potential_of_a_known_game(spark):
    """v(S) = number of rows failing any of S: with rows failing {A}, {A, B} and all five the values are known."""
    counts = spark.createDataFrame([("p", 1, 10, 0, 0), ("p", 3, 6, 0, 0), ("p", 31, 5, 0, 0)], "part string, bits int, n long, good long, toxic long")
    p = A.potentials(A.worths(counts)).select(F.col("potential")).first()[0]
    shapley = [(p[31] - p[31 - (1 << k)]) / 120 for k in range(5)]
    assert shapley == [10 + 3 + 1, 3 + 1, 1, 1, 1]


def test_labels_and_digests_are_broadcast_at_no_size(spark, monkeypatch):
    """Each label comes in SALTS copies, which Spark's estimate for a broadcast does not count."""
    plans, stored = [], A.stored

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, *args)

    monkeypatch.setattr(A, "stored", seen)
    docs = spark.createDataFrame([(i, f"text {i}", "web", "", 0) for i in range(20)], DOCS)
    out = A.failure_counts(docs, spark.createDataFrame([(3, 1, 0, "")], LABELS))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) == 2 and not any("Broadcast" in p for p in plans)
    assert sum(r.n for r in out.collect()) == 20 and sum(r.good for r in out.collect()) == 1
