"""Steps that read, parse or match a document once, and shuffle its rows once."""
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from noteweave.functions.partitioning import dense_rank_within
from noteweave.operators import deid, exchange
from noteweave.operators import sections as S
from noteweave.functions.rules import SENSITIVE_FIELDS, WORKING_FIELDS
from noteweave.plans import q_jobs
from noteweave.plans.q_deid import RULES
from noteweave.sources import nlp_json


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def merge_only(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_numbering_shuffles_rows_once(spark):
    """One exchange of the rows, two of the small counts."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    merge_only(spark)
    try:
        df = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (None, 1, "z")], "doc long, s int, t string").withColumn("b", F.floor(F.col("s") / 4))
        text = plan(dense_rank_within(df, "doc", ["s"], "b", "n"))
        assert text.count("Exchange hashpartitioning") <= 4, text
        assert sum("_at" in line for line in text.splitlines() if "Exchange hashpartitioning" in line) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_xml_is_parsed_once_and_meets_its_classes(spark):
    xml = ('<annotations><annotation><mention id="a"/><span start="1" end="3"/><spannedText>t1</spannedText></annotation>'
           '<classMention id="a"><mentionClass id="first">t1</mentionClass></classMention>'
           '<annotation><mention id="b"/><span start="1" end="3"/><spannedText>t2</spannedText></annotation>'
           '<classMention id="a"><mentionClass id="second">t1</mentionClass></classMention></annotations>')
    read = exchange.read_ehost(spark.createDataFrame([("f", xml), ("g", "<annotations></annotations>")], "file string, xml string"))
    assert plan(read).count("from_xml") + plan(read).count("xmltostructs") <= 1, plan(read)
    assert sorted(map(tuple, read.collect())) == [("f", "m-1-3:1", "t1", "first"), ("f", "m-1-3:2", "t2", None)]


def test_annotators_are_compared_in_one_pass(spark):
    a = spark.createDataFrame([("f", "k1", "t", "A"), ("f", "k2", "t", "B"), ("f", "k3", "t", "VERIFIED_CORRECT"), (None, "k4", "t", "C"), ("f", "k5", "t", None)], "file string, ann_key string, text string, class string")
    b = spark.createDataFrame([("f", "k2", "t", "X"), ("f", "k2", "t", "Y"), ("f", "k3", "t", "Z"), (None, "k4", "t", "D"), ("f", "k5", "t", "E")], "file string, ann_key string, text string, class string")
    got = exchange.compare_annotators(a, b)
    assert plan(got).count("Join") <= 2
    assert sorted((r.ann_key, r.kind, r.class2 or "") for r in got.collect()) == [("k1", "missed", ""), ("k2", "mismatched", "X"), ("k2", "mismatched", "Y"), ("k4", "missed", "")]
    missed, mism, totals = exchange.inter_annotator(a, b)
    assert missed.count() == 2 and mism.count() == 2 and totals.first()[0] == 5 and missed.columns == a.columns


def test_rules_run_once_for_numbered_findings(spark):
    reports = spark.createDataFrame([(1, "[[ContentSequence]]\nTel: 0131 555 2222 seen by Dr. Jane Smith\n")], "doc_id long, text string")
    lines = exchange.phi_ehost_lines(deid.phi_table(deid.deidentify(reports, RULES, WORKING_FIELDS, SENSITIVE_FIELDS)))
    assert plan(lines).count("ArrowEvalPython") == 1, plan(lines)


def test_json_lines_are_parsed_once(spark):
    note = spark.createDataFrame([(10, 0, "mäh", 0, 4, 5, 9, 10, 14, 6, 8)], "doc_id long, tid int, mention string, s0 int, e0 int, s1 int, e1 int, s2 int, e2 int, m_start int, m_end int")
    docs, bad = nlp_json.parse_lines(q_jobs.raw_lines(note))
    rows = nlp_json.annotation_rows(docs)
    # once as it stands and once repaired; before, each filter and each kind of rows parsed again
    assert plan(rows).count("from_json") == 2, plan(rows)
    assert bad.count() == 0
    assert sorted((r.kind, r.id, r.ann_no, r.start_pos) for r in rows.collect()) == [
        ("Mention", "cui-1", 1, 6), ("Phenotype", "phe-1", 1, 6), ("Sentence", "sent-1", 3, 10), ("Sentence", "sent-2", 2, 5), ("Sentence", "sent-3", 1, 0)]
    m, p, s = nlp_json.load_annotations(docs)
    assert (m.first().str, p.first().minor_type, s.count()) == ('Q"mäh', "tid_0", 3)


def test_sifted_rules_find_what_finditer_finds():
    compiled = deid._compiled(deid._spec(RULES))
    assert sum(r[10] is not None for r in compiled) >= 20
    rnd = random.Random(7)
    bits = ["a", "b", " ", "A", "1", "2", "0", "\n", "EH1 2NG", "flat 3", "Dr. ", "Smith ", "12/03/2001", "10 May 2001", "May", "07123456789", "01234 567890", "x@y.z",
            " yo", "46 y.o", "69M", "CHI NUMBER: 12", "ID: 5", "\t", "\x0b", "é", "٣", ":", "(", "/", ")", "Hospital", "on 1/2", "1999", "at 1200", "\r", "-", ".", "\x1c", "ſ", " ", "9876543210", "_"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + [None]
    for t, (same, found) in zip(texts, deid._each_found(pa.array(texts), compiled)):
        got = [(compiled[k][0], m.span(), m.groups()) for k, matches, _ in found for m in matches]
        assert t == same and got == ([] if t is None else [(r[0], m.span(), m.groups()) for r in compiled for m in r[1].finditer(t)]), t


def test_sift_patterns_let_every_match_through():
    assert deid.sift_pattern(r"(?<![\.0-9])(07\d{2})\Z", 0) == r"(?:(07\d{2})\z)"
    assert deid.sift_pattern(r"a$", 0) is None and deid.sift_pattern(r"(a)\1", 0) is None
    assert deid.sift_pattern(r"a$", re.MULTILINE) == r"(?m:a$)"


def test_closure_levels_send_nothing_through_the_driver(spark, monkeypatch):
    """No join of a level broadcasts, and one setting for all roots needs no join with the roots."""
    from noteweave.operators import ontology
    plans = []
    kind = type(spark.range(1))
    own = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda df, *a, **k: (plans.append(plan(df)), own(df, *a, **k))[1])
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "cui1 string, cui2 string")
    got = ontology.narrower_closure(edges, edges.select(edges.cui1.alias("root")), depth=2, prune=["d"]).collect()
    assert sorted((r.root, r.cui, r.depth) for r in got) == [(x, y, k) for x, ys in (("a", "abc"), ("b", "bca"), ("c", "cab")) for y, k in sorted(zip(ys, range(3)))]
    levels = [p for p in plans if "LeftAnti" in p]
    assert len(levels) == 2 and not any("Broadcast" in p for p in levels)
    assert all(p.count("SortMergeJoin") == 2 for p in levels)


def test_ascii_and_other_texts_match_alike(spark):
    from noteweave.operators.context import matches
    df = spark.createDataFrame([("No evidence of x",), ("no evidence  of \u00e9",), ("", ), (None,), ("K\u0131ss no",)], "t string")
    got = [r[0] for r in df.select(matches(F.col("t"), [r"^.*\bno\s+evidence.*$", r"k\wss"], False)).collect()]
    assert got == [True, True, False, None, True]


def test_sections_by_the_lazy_pattern(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["[[", "]]", "[", "]", "a", "\n", "b c", "[[T]]", "é"]) for _ in range(rnd.randrange(30))) for _ in range(300)] + ["[[A]]" + "[x" * 50_000, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in S.split_sections(df).collect())
    lazy = re.compile(r"(?s)\[\[([^\]]+)\]\](.*?)(?=\[\[[^\]]+\]\]|\Z)")
    assert got == sorted((d, i, m.group(1), m.group(2)) for d, t in enumerate(texts) for i, m in enumerate(lazy.finditer(t), 1))


def test_a_weaker_match_that_is_no_match_hides_none():
    """Where the form without look-around matches elsewhere or farther, the rule goes on alone from there."""
    rules = ((0, r"(?<!x)(\d{3})", 0, ("number",), "t"), (1, r"(a+(?!b))", 0, ("name",), "t"), (2, r"\b(\w*)\b", 0, ("name",), "t"), (3, r"((?:ab|a)(?!c))", 0, ("name",), "t"))
    compiled = deid._compiled(rules)
    assert [r[10] is not None for r in compiled] == [True, True, False, True]
    rnd = random.Random(11)
    texts = ["x123456", "aab", "", "abc ab"] + ["".join(rnd.choice("xab1 2c") for _ in range(rnd.randint(1, 25))) for _ in range(500)]
    calls = []
    own, deid._confirmed = deid._confirmed, lambda *a: calls.append(a) or own(*a)
    try:
        for t, (_, found) in zip(texts, deid._each_found(pa.array(texts), compiled)):
            got = [(k, m.span(), m.groups()) for k, matches, _ in found for m in matches]
            assert got == [(r[0], m.span(), m.groups()) for r in compiled for m in r[1].finditer(t)], t
    finally:
        deid._confirmed = own
    assert len(calls) > 500 and {a[0].pattern for a in calls} == {rules[k][1] for k in (0, 1, 3)}


def test_header_values_by_column():
    """As ``_joined`` gives them row by row, also of slices, null rows and repeated fields."""
    rows = [[("a", "1"), ("b", "2")], None, [], [("a", "x"), ("b", "y"), ("a", "z")], [("c", "é")]]
    kind = pa.list_(pa.struct([("field", pa.string()), ("value", pa.string())]))
    pairs = pa.array([r and [{"field": f, "value": v} for f, v in r] for r in rows], kind)
    want = [deid._joined(r or ()) for r in pairs.to_pylist()]
    assert deid._header_values(pairs) == want == [["1", "2"], [], [], ["x z", "y"], ["é"]]
    assert deid._header_values(pairs.slice(2, 2)) == want[2:4] and deid._header_values(pairs.slice(0, 0)) == []


def test_masks_and_folds_of_many_texts_at_once():
    from noteweave.operators import literals as L
    for part in ("".join(map(chr, range(128))), "Dr. Smith\n12", "é   x", "", "a\x1cb"):
        assert L._crossed(part) == re.sub(r"\S", "x", part)
    for texts in (["A", "", "bC"], ["A\0B", "C"], ["ſ", "K", "É"], [], [""]):
        assert L._folds(texts) == [L.fold(x) for x in texts]
    assert L.scrubbed("nothing here", [("Smith", True), ("qq", False)]) == ([], "nothing here")
