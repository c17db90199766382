"""search(): free-text terms, text with qualifiers, and mixing with CUI terms."""
from datetime import date

from pyspark.sql import functions as F

from conftest import SF
from noteweave.operators import search
from noteweave.operators.search import SearchQuery, Term
from noteweave.plans import inputs


def _ids(df, col="SOPInstanceUID"):
    return sorted(r[0] for r in df.select(col).collect())


def test_text_terms(spark):
    docs, anns = inputs.documents(spark, SF), inputs.annotations(spark, SF)
    run = lambda q: search.search(spark, docs, anns, q, modality_sep="|", today=date(2026, 1, 1))
    # plain text -> full-text search over preferred labels
    got = _ids(run(SearchQuery([Term('"red bolt"')])))
    want_docs = search.text_search(anns, docs, '"red bolt"')
    want = _ids(docs.join(want_docs, "doc_id", "left_semi"), "sopinstanceuid")
    assert got == want and got
    # text with qualifiers -> pref equality on the same annotation
    got = _ids(run(SearchQuery([Term("RED BOLT", negation="Negated")])))
    d = anns.where((F.col("pref") == "RED BOLT") & (F.col("negation") == "Negated")).select("doc_id")
    assert got == _ids(docs.join(d, "doc_id", "left_semi"), "sopinstanceuid")
    # a CUI term AND a text term
    cuis = [f"C{k:07d}" for k in range(1, 200)]
    got = _ids(run(SearchQuery([Term(cuis), Term("bolt")])))
    a = anns.where(F.col("cui").isin(cuis)).select("doc_id")
    b = search.text_search(anns, docs, "bolt")
    want = docs.join(a, "doc_id", "left_semi").join(b, "doc_id", "left_semi")
    assert got == _ids(want, "sopinstanceuid")


def _anns(spark, rows):
    return spark.createDataFrame([(d, 1, "C1", p, p, t, "Affirmed", "Patient", "Recent") for d, p, t in rows],
                                 "doc_id long, ann_no int, cui string, str string, pref string, sty string, negation string, experiencer string, temporality string")


def test_words_of_any_script_and_empty_queries(spark):
    anns = _anns(spark, [(1, "Бронхиальная астма", "T1"), (2, "café-au-lait spot", "T1"), (3, "asthma", "T1")])
    find = lambda q: sorted(r.doc_id for r in search.text_search(anns, anns, q).collect())
    assert find("астма") == [1] and find("café") == [2] and find('"au lait"') == [2] and find("caf") == []
    assert find("...") == [] and find("") == []
    assert find("asthma or астма") == [1, 3] and find("-asthma") == [1, 2]


def test_semantic_type_of_a_text_term(spark):
    docs = inputs.documents(spark, SF)
    ids = [r.doc_id for r in docs.select("doc_id").orderBy("doc_id").limit(2).collect()]
    anns = _anns(spark, [(ids[0], "asthma", "T1"), (ids[1], "asthma", "T2")])
    got = search.search(spark, docs, anns, SearchQuery([Term("asthma", sty="T1")]), modality_sep="|")
    assert got.count() == 1


def test_unknown_mapping_leaves_rows(spark):
    anns = _anns(spark, [(1, "asthma", "T1")])
    mapping = spark.createDataFrame([("m", "C9", "x")], "map_name string, cui string, term string")
    assert [r.mapped for r in search.anns_by_mapping(anns, mapping, "nowhere").collect()] == [None]
    assert search.anns_by_mapping(anns, mapping, "m").count() == 0
