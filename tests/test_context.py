"""Context rules against the expectations worked out from the rule files (FIXTURES F4)."""
from pyspark.sql import functions as F

from conftest import SF
from noteweave.plans import registry
from noteweave.plans.inputs import view

EXPECTED = {0: "", 1: "negation_filters.json", 2: "negation_filters.json", 3: "other_experiencer_filters.json",
            4: "hypothetical_filters.json", 5: "not_mention_filters.json", 6: "not_mention_filters.json",
            7: "hypothetical_filters.json", 8: "cris_document_filters.json", 9: "cris_cutoff_filters.json",
            10: "negation_filters.json", 11: "other_experiencer_filters.json"}


def test_verdict_per_template(spark):
    registry.load_all()
    r = registry.QUERIES["rule_verdict"](spark, SF)
    n = view(spark, SF, "f_note").select("doc_id", "tid", "mention")
    rows = r.join(n, "doc_id").collect()
    assert len(rows) == 1500
    cva = [x for x in rows if x.mention == "CVA"]
    assert len(cva) == 120 and all(x.ruled_by == "skip terms" for x in cva)
    for x in rows:
        if x.mention == "CVA":
            continue
        exp = EXPECTED[x.tid]
        if x.mention == "ABC" and x.tid != 9:
            exp = "|".join([e for e in (exp, "s_abbr.json") if e])
        assert x.ruled_by == exp, (x.doc_id, x.tid, x.mention, x.ruled_by)


def test_relocation_moves_shifted_mentions_back(spark):
    registry.load_all()
    r = registry.QUERIES["relocate"](spark, SF)
    shifted = r.where(F.col("doc_id") % 6 == 0).collect()
    assert shifted and all(x.offset == -2 for x in shifted)
    assert r.where((F.col("doc_id") % 6 != 0) & (F.col("offset") != 0)).count() == 0


def test_sentence_texts_by_brute_force(spark, monkeypatch):
    """Relocation and sentence slices, a document dealt to several tasks, texts that are missing, empty or fold oddly."""
    import random
    import re

    from noteweave.operators import context

    monkeypatch.setattr(context, "SHARED", 7)
    rnd = random.Random(12)
    texts = {1: "Red bolt. A red  Bolt? No bolts, red bolt e.g. ſafe red. " * 6, 2: "", 3: None, 4: "Öl red bolt"}
    rows = []
    for i in range(90):
        d = rnd.choice([1, 1, 1, 2, 3, 4, 9])
        a = rnd.randrange(-2, 60)
        s0 = rnd.choice([None, rnd.randrange(0, 50)])
        span = lambda: rnd.choice([None, (rnd.randrange(0, 90), rnd.randrange(0, 90))])
        rows.append((d, i, a, a + 8, rnd.choice(["red bolt", "safe", "bolt", "", None, "nowhere"]), s0, None if s0 is None else s0 + 20, span(), span(), span(), span(), "x"))
    st = "struct<start_pos:int,end_pos:int>"
    m = spark.createDataFrame(rows, f"doc_id long, ann_no int, start_pos int, end_pos int, str string, sent_start int, sent_end int, p {st}, n {st}, pp {st}, nn {st}, cui string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cut = lambda t, a, b: None if t is None or a is None or b is None else t[max(a, 0):max(b, 0)]
    got = {r.ann_no: r for r in context.sentence_texts(m, docs).collect()}
    assert len(got) == len(rows)
    moved = 0
    for d, i, a, e, w, s0, s1, *spans, cui in rows:
        t, off = texts.get(d), 0
        if None not in (t, w, s0) and cut(t, a, e) != w and cut(cut(t, s0, s1), a - s0, e - s0).lower() != w.lower() and w:
            at = [x.start() for x in re.finditer(r"\b" + re.escape(w) + r"\b", t, re.I)]
            off = min(((abs(x - a), x - a) for x in at), default=(0, 0))[1]
            off = next((x - a for x in sorted(at) if abs(x - a) == abs(off)), 0)
        moved += off != 0
        r = got[i]
        assert (r.offset, r.cui, r._ctx) == (off, cui, cut(t, *(None if x is None else x + off for x in (s0, s1)))), i
        for have, sp in zip((r._prev, r._next, r._pp, r._nn), spans):
            assert have == (None if sp is None else cut(t, sp[0] + off, sp[1] + off))
    assert moved > 5
