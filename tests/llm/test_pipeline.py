"""The pipeline's stages against brute force, each on its predecessor's output."""
import corpus_pipeline as P
import pytest
from test_bwt_dedup import brute as repeats
from test_decontam import brute as leaks
from test_near_dup import brute as groups

import __spark_entry__ as entry
from noteweave.llm.quality import quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def taken(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_and_entry(steps):
    assert all(s.columns == COLUMNS for s in steps[:-1])
    assert steps[-1].columns == [*COLUMNS, "n_tokens", "domain", "rate", "copies"]
    assert entry.queries()["pipeline"] is P.run


def test_quality_stage(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id for r in quality(steps[0], labels).filter("predicted = 1").collect()}
    assert {i for i, in taken(steps[1], "doc_id")} == want and len(want) < steps[0].count()


def test_near_duplicate_stage(steps):
    rows = taken(steps[1], "doc_id", "text")
    assert sorted(i for i, in taken(steps[2], "doc_id")) == [i for i, _, _, kept in groups(rows, P.SIMILAR) if kept]
    assert set(taken(steps[2], *COLUMNS)) <= set(taken(steps[1], *COLUMNS))


def test_repeat_stage(steps):
    before = dict(taken(steps[2], "doc_id", "text"))
    after = dict(taken(steps[3], "doc_id", "text"))
    assert before.keys() == after.keys() and any(before[i] != after[i] for i in before)
    for i, n_bytes, removed, _, _ in repeats(list(before.items())):
        assert n_bytes - removed - 3 * 50 < len(after[i].encode()) <= n_bytes - removed
        assert removed or after[i] == before[i]
    assert all(len(t) == n for t, n in taken(steps[3], "text", "n_chars"))


def test_decontamination_stage(spark, steps):
    rows = taken(steps[3], "doc_id", "text")
    items = taken(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text")
    assert sorted(i for i, in taken(steps[4], "doc_id")) == sorted(r[0] for r in leaks(rows, items) if not r[5])


def test_mixing_stage(steps):
    got = steps[5].collect()
    assert all(r.copies >= 1 and abs(r.copies - r.rate) < 1 for r in got)
    assert {r.doc_id for r in got} <= {i for i, in taken(steps[4], "doc_id")}


def test_odd_rows_and_clashing_names(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, kept int, spans int, n_hit int, items int, rate int, copies int"
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *[7] * 7) for r in base]
    rows += [rows[0], (None, rows[1][1], None, None, None, *[None] * 7), (10**9, None, None, None, None, *[7] * 7), (10**9 + 1, "", "en", "x", 0, *[7] * 7)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {r.score for r in out.collect()} <= {7, None}
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert [r.doc_id for r in P.near_duplicate_stage(spark, docs, SF).collect()].count(rows[0][0]) == 1
    out = P.mixing_stage(spark, docs, SF)
    assert out.columns[-4:] == ["n_tokens", "domain", "rate_", "copies_"] and out.count()
    assert P.mixing_stage(spark, docs.limit(0), SF).collect() == []


def test_near_duplicates_from_four_fifths(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles; a new end of n words replaces n of them
    texts = [" ".join(words), " ".join(words[:-10] + [f"x{i}" for i in range(10)]), " ".join(words[:-20] + [f"y{i}" for i in range(20)])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    # 90 of 110 shared (0.82); 80 of 120 (0.67)
    assert sorted(r.doc_id for r in P.near_duplicate_stage(spark, docs, SF).collect()) == [0, 2]
