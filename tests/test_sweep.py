"""C3 and V4 sweeps against brute force, over bin borders, and on one dense document."""
import random
import time

from noteweave.operators import sweep


def brute_removed(rows):
    gone = set()
    for d in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == d and r[2] is not None and r[3] is not None), key=lambda r: (r[2], r[1]))
        for i, r in enumerate(own):
            group = [x for x in own[i + 1:] if x[2] < r[3]]
            if group:
                group.append(r)
                best = max(group, key=lambda x: (x[3] - x[2], x[2], x[1]))
                gone |= {x[:2] for x in group if x != best}
    return gone


def test_overlaps_by_brute_force(spark):
    rnd = random.Random(9)
    rows = []
    for d in range(30):
        for i in range(rnd.choice([1, 3, 40])):
            s = rnd.choice([rnd.randrange(60), rnd.randrange(4080, 4110), rnd.randrange(20_000)])
            rows.append((d, i + 1, s, s + rnd.choice([0, 1, 5, 30, 5000, -2])))
    rows += [(50, 1, None, 4), (50, 2, 3, None), (None, 1, 2, 9), (None, 2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, idx int, s int, e int").repartition(4)
    got = [tuple(r) for r in sweep.covered(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_removed(rows)
    assert sweep.covered(df.limit(0)).collect() == []


def test_sentences_by_brute_force(spark):
    rnd = random.Random(10)
    sents, ments = [], []
    for d in range(25):
        for k in range(rnd.choice([0, 1, 30])):
            s = rnd.choice([rnd.randrange(100), rnd.randrange(4000, 4200), rnd.randrange(15_000)])
            sents.append((d, k + 1, s, s + rnd.choice([0, 10, 40, 6000])))
        for k in range(40):
            s = rnd.choice([rnd.randrange(150), rnd.randrange(4000, 4300), rnd.randrange(16_000)])
            ments.append((d, k + 1, s, s + rnd.choice([1, 9, 200])))
    ments.append((3, 99, None, None))
    want = {}
    for d, k, a, b in ments:
        hold = [(s, no) for dd, no, s, e in sents if dd == d and a is not None and (s <= a <= e or s <= b <= e)]
        if hold:
            want[d, k] = min(hold)[1]
    got = sweep.sentence_of(spark.createDataFrame(ments, "doc_id long, ann_no int, start_pos int, end_pos int"),
                            spark.createDataFrame(sents, "doc_id long, sent_no int, start_pos int, end_pos int")).collect()
    assert {(r.doc_id, r.ann_no): r.sent_no for r in got} == want and len(got) == len(want)


def test_one_dense_document_is_linear(spark):
    """200,000 annotations within 4,000 characters: all pairs would be 4e10 rows."""
    df = spark.range(200_000).selectExpr("1L as doc_id", "cast(id as int) as idx", "cast(id % 4000 as int) as s", "cast(id % 4000 + 1 + id % 37 as int) as e")
    t = time.time()
    n = sweep.covered(df).count()
    m = sweep.sentence_of(df.selectExpr("doc_id", "idx as ann_no", "s as start_pos", "e as end_pos"),
                          spark.range(100).selectExpr("1L as doc_id", "cast(id as int) as sent_no", "cast(id * 40 as int) as start_pos", "cast(id * 40 + 39 as int) as end_pos")).count()
    assert m == 200_000 and n > 190_000 and time.time() - t < 60


def test_bins_that_nothing_crosses_give_only_what_goes(spark):
    """Groups leave the sweep only from bins that an annotation enters or leaves; a bin with an idx twice is summed as before."""
    rnd = random.Random(11)
    rows = [(d, i + 1, s, s + rnd.choice([0, 1, 5, 30, -2])) for d in range(20) for i in range(30) for s in [rnd.randrange(200)]]
    df = spark.createDataFrame(rows, "doc_id long, idx int, s int, e int").repartition(4)
    parts = sweep._parts(df).collect()
    assert all(r.reach > 0 for r in parts) and {(r.doc_id, r.idx) for r in parts} == brute_removed(rows)
    far = [(d, i + 31, 4090 + 2 * i, 4095 + 3 * i) for d in range(20) for i in range(5)]
    both = df.unionByName(spark.createDataFrame(rows[:0] + far, df.schema))
    assert {tuple(r) for r in sweep.covered(both).collect()} == brute_removed(rows + far)
    again = spark.createDataFrame([(1, 1, 0, 9), (1, 1, 2, 5), (1, 2, 3, 30)], df.schema)
    assert sweep._parts(again).where("reach = 0").count() == 2
