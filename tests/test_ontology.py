"""Closure properties and search-token classification."""
from pyspark.sql import functions as F

from conftest import SF
from noteweave.operators import ontology, search
from noteweave.operators.search import SearchQuery, Term
from noteweave.plans.inputs import view
from noteweave.plans.q_ontology import SOURCES


def _edges(spark):
    return ontology.narrower_edges(view(spark, SF, "f_edge"), SOURCES)


def test_closure_grows_with_depth(spark):
    e = _edges(spark)
    roots = e.select(F.col("cui1").alias("root")).distinct()
    prev = None
    for d in (0, 1, 2, 999):
        cur = {tuple(r) for r in ontology.narrower_closure(e, roots, depth=d).select("root", "cui").collect()}
        if prev is not None:
            assert prev <= cur
        else:
            assert all(a == b for a, b in cur)  # depth 0 = the root only
        prev = cur


def test_published_shape_of_c0000001(spark):
    """FIXTURES F3: closure of C0000001 adds 1, 2, 4, 6, 11 concepts at depths 0-4."""
    e = _edges(spark)
    roots = spark.createDataFrame([("C0000001",)], "root string")
    c = ontology.narrower_closure(e, roots, depth=4).groupBy("depth").count().orderBy("depth").collect()
    assert [r["count"] for r in c] == [1, 2, 4, 6, 11]


def test_token_classification(spark):
    """Golden cases: free text and unknown codes give nothing; CUIs and comma lists resolve."""
    qs = [SearchQuery([Term("lung")]), SearchQuery([Term("1234567")]), SearchQuery([Term("C123456")]),
          SearchQuery([Term("C123456,C654321")]), SearchQuery([Term(["C123456", "C654321"])])]
    t = search.terms_frame(spark, qs)
    snomed = spark.createDataFrame([("7654321", "C0000009")], "snomed string, cui string")
    r = search.resolve_terms(t, snomed=snomed)
    got = {}
    for row in r.collect():
        got.setdefault(row.query_id, set()).add(row.cui)
    assert got.get(0) is None and got.get(1) is None
    assert got[2] == {"C123456"}
    assert got[3] == {"C123456", "C654321"} and got[4] == {"C123456", "C654321"}


def test_disjoint_concepts_hold_each_cui_once(spark):
    from noteweave.operators import study
    from noteweave.plans.inputs import study as study_view
    s = study_view(spark, SF)
    d = study.disjoint_concepts(s)
    assert d.count() == d.select("cui").distinct().count() == s.select("cui").distinct().count()
    # the owner is the highest-ord concept holding the CUI
    top = s.groupBy("cui").agg(F.max("ord").alias("ord"))
    assert d.join(top, ["cui", "ord"], "left_anti").count() == 0


def test_unified_view_with_phenotypes(spark):
    from noteweave.operators import display
    m = spark.createDataFrame(
        [(1, 1, 0, 5, "T1", "PREF A", "Affirmed", "Patient", "Recent", [])],
        "doc_id long, ann_no int, start_pos int, end_pos int, sty string, pref string, negation string, "
        "experiencer string, temporality string, ruled_by array<string>")
    p = spark.createDataFrame(
        [(1, 1, 2, 9, "stroke", "cerebro", "Affirmed", "Patient", "Recent", ["negation_filters.json"]),
         (2, 1, 0, 3, "cva", "cerebro", "Negated", "Other", "hypothetical", [])],
        "doc_id long, ann_no int, start_pos int, end_pos int, str string, minor_type string, negation string, "
        "experiencer string, temporality string, ruled_by array<string>")
    v = {(r.doc_id, r.idx): (r.category, r.label) for r in display.unify(m, p).collect()}
    assert v == {(1, 1): ("umls", "PREF A"), (1, 2): ("customised", "stroke"), (2, 1): ("customised", "cva")}
    kept = {(r.doc_id, r.idx) for r in display.remove_overlaps(display.unify(m, p)).collect()}
    assert kept == {(1, 2), (2, 1)}  # (1,1) spans 0-5, (1,2) spans 2-9: the longer one stays


def test_closure_deeper_than_any_cap(spark):
    import pytest
    edges = spark.createDataFrame([(f"C{i}", f"C{i + 1}") for i in range(60)], "cui1 string, cui2 string")
    roots = spark.createDataFrame([("C0",)], "root string")
    assert ontology.narrower_closure(edges, roots).count() == 61
    assert ontology.narrower_closure(edges, roots, depth=7).count() == 8
    with pytest.raises(ValueError):
        ontology.narrower_closure(edges, roots, same_group=True)
