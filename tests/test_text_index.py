"""Stems, and the positional index against a brute force over labels."""
import random

from noteweave.functions.english import STOP_WORDS, stem
from noteweave.operators import search, text_index
from noteweave.operators.search import SearchQuery, Term

# published pairs of word and stem
PAIRS = """consigned consign consistency consist consolation consol consolingly consol conspicuously conspicu conspirators conspir
constables constabl constancy constanc knackeries knackeri knavish knavish kneaded knead knightly knight knives knive generously generous
generate generat hopping hop hoped hope cries cri ties tie dying die by by say say relational relat abnormalities abnorm nodules nodul
plates plate plating plate bolts bolt succeeded succeed skis ski news news fluently fluentli asthmatic asthmat gas gas this this
happily happili allergies allergi ogi ogi analogies analog controlled control fizzed fizz""".split()


def test_published_stems():
    assert [(w, stem(w)) for w in PAIRS[::2]] == list(zip(PAIRS[::2], PAIRS[1::2]))
    assert stem("астмы") == "астмы" and stem("x1s") == "x1s" and stem("") == ""


def _anns(spark, rows):
    return spark.createDataFrame([(d, 1, "C1", p, p, "T", n, "Patient", "Recent") for d, p, n in rows],
                                 "doc_id long, ann_no int, cui string, str string, pref string, sty string, negation string, experiencer string, temporality string")


def _holds(labels, q):
    """Whether a document with these labels satisfies a web-search text; None if no word counts."""
    words = [search.re.findall(r"[^\W_]+", x.lower()) for x in labels]
    found = lambda own: any(all(i + s < len(ws) and stem(ws[i + s]) == t for s, t in own) for ws in words for i in range(-9, len(ws)) if all(i + s >= 0 for s, _ in own))
    groups = []
    for group in search.parse_websearch(q):
        lits = [(n, [(i, stem(w)) for i, w in enumerate(ws) if w not in STOP_WORDS]) for n, ws in group]
        lits = [(n, own) for n, own in lits if own]
        if lits:
            groups.append(lits)
    return bool(groups) and all(any(found(own) != n for n, own in g) for g in groups)


def test_index_by_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    vocab = ["bolt", "Bolts", "bolting", "the", "of", "red", "gear", "gears", "астма", "x1"]
    labels = {d: [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 4))] for d in range(60)}
    anns = _anns(spark, [(d, x, "Affirmed") for d, xs in labels.items() for x in xs] + [(70, None, "Affirmed"), (None, "bolt", "Affirmed")])
    docs = spark.createDataFrame([(d,) for d in [*labels, 70]], "doc_id long")
    lit = lambda: rnd.choice(["", "", "-"]) + rnd.choice(['"%s %s"' % (rnd.choice(vocab), rnd.choice(vocab)), '"red the %s"' % rnd.choice(vocab), rnd.choice(vocab)])
    texts = [rnd.choice([" ", " or "]).join(lit() for _ in range(rnd.randrange(1, 4))) for _ in range(80)] + ["", "the of", "-the", '"of the"']
    index = text_index.build_index(anns).write(str(tmp_path / "index"))
    got = {}
    for r in text_index.text_hits(index, docs, [(k, 0, t) for k, t in enumerate(texts)]).collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == [d for d in [*labels, 70] if _holds(labels.get(d, []), t)], t


def test_batch_mixes_text_and_concepts(spark):
    anns = _anns(spark, [(1, "Red bolts", "Negated"), (2, "red bolt", "Affirmed"), (3, "gear", "Affirmed")])
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    batch = [SearchQuery([Term("bolt")]), SearchQuery([Term("Red bolts", negation="Negated")]), SearchQuery([Term("C00001", qdepth=0), Term("gear")]), SearchQuery([Term("nothing")])]
    got = sorted(tuple(r) for r in text_index.batch_docs(anns.replace("C1", "C00001"), docs, batch).collect())
    assert got == [(0, 1), (0, 2), (1, 1), (2, 3)]
