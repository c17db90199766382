"""D8/D9 by automaton against regex by regex, case classes against ``re``, and linear cost."""
import random
import re
import time

import pytest

from noteweave.operators import deid
from noteweave.operators import literals as L


def pattern(x, word):
    return re.compile((r"\b" + re.escape(x) + r"\b") if word else re.escape(x), re.IGNORECASE)


def brute(text, literals):
    found = [(m.start(), m.group()) for x, w in literals if x for m in pattern(x, w).finditer(text)]
    now = text
    for x, w in literals:
        if x:
            now = pattern(x, w).sub("Q" * len(x), now)
    return found, now


@pytest.mark.parametrize("alphabet", ["aAb ", "qQa-", "aß sSſ", "iİıI.", "σςΣ_ ", "kKK(x)"])
def test_by_brute_force(alphabet):
    rnd = random.Random(alphabet)
    for _ in range(1500):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40)))
        literals = [("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(5))), rnd.random() < 0.4) for _ in range(rnd.randrange(9))]
        literals += literals[:2]
        found, now = brute(text, literals)
        assert L.residual(text, literals) == found, (text, literals)
        assert L.replaced(text, literals) == now, (text, literals)


def test_case_classes_are_those_of_re():
    for c in range(0x2FF00):
        ch = chr(c)
        if 0xD800 <= c < 0xE000:
            continue
        low = L.fold(ch)
        assert len(low) == 1
        for other in {low, ch.lower(), ch.upper(), ch.title(), ch.swapcase()} - {ch}:
            if len(other) == 1:
                assert bool(re.fullmatch(re.escape(other), ch, re.I)) == (L.fold(other) == low), hex(c)


def test_masked_covers_the_union_of_spans():
    rnd = random.Random(2)
    for _ in range(500):
        text = "".join(rnd.choice("ab \n é") for _ in range(30))
        spans = [(a, min(30, a + rnd.randrange(8))) for a in (rnd.randrange(30) for _ in range(5))]
        want = "".join("x" if any(a <= i < e for a, e in spans) and not re.match(r"\s", c) else c for i, c in enumerate(text))
        assert L.masked(text, spans) == want


def test_long_text_of_many_literals_is_linear():
    """100,000 words, 10,000 literals: all in one pass, where a pass a literal takes minutes."""
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(10**6)}z" for _ in range(100_000)]
    text, literals = " ".join(words), [(w, i % 2 == 0) for i, w in enumerate(words[:20_000:2])]
    t = time.time()
    found, now = L.residual(text, literals), L.replaced(text, literals)
    assert time.time() - t < 20
    assert len(found) >= 10_000 and len(now) == len(text)
    some = rnd.sample(range(len(literals)), 40)
    for k in some:
        x, w = literals[k]
        assert not pattern(x, w).search(now)
        assert {at for at, s in found if s == x} == {m.start() for m in pattern(x, w).finditer(text)}


def test_columns(spark):
    df = spark.createDataFrame([(1, "Ann and ANNE, ann", [("ann", True), ("Anne", False)]), (2, None, [("x", False)]), (3, "text", [])],
                               "doc_id int, text string, lits array<struct<lit:string,word:boolean>>")
    out = {r.doc_id: r for r in df.select("doc_id", deid.literal_spans(df.text, df.lits).alias("s"), deid.replace_literals_col(df.text, df.lits).alias("t")).collect()}
    assert [tuple(x) for x in out[1].s] == [(0, "Ann"), (14, "ann"), (8, "ANNE")] and out[1].t == "QQQ and QQQQ, QQQ"
    assert out[2].s == [] and out[2].t is None and out[3].t == "text"


def test_leading_literals():
    assert deid.leading_literals(r"\b(Dr|Prof)\. {0,}(x)") == ("Dr", "Prof")
    assert deid.leading_literals(r"((secretary to|reception)[^\d]+(\d))") == ("secretary to", "reception")
    assert deid.leading_literals(r"(report to|for attention of|\bcc)\:{0,1}\s+") == ("report to", "for attention of", "cc")
    assert deid.leading_literals(r"tels?(\d+)") == ("tel",) and deid.leading_literals(r"UNIT#\:{0,1}") == ("UNIT#",)
    assert deid.leading_literals(r"(No\.)\:") == ("No.",) and deid.leading_literals(r"ab|cd") == ("ab", "cd")
    for p in (r" {0,}(tel|fax)", r"(tel|fax)?x", r"\d+ tel", r"(a|tel)", r"[ab]cd", r"^tel", r"(?<!x)tel", r"(?:tel|\d)", r"x?y"):
        assert deid.leading_literals(p) is None, p


def test_rule_places_find_what_finditer_finds():
    """Every active rule on texts made of its own words, with and without the automaton's help."""
    from noteweave.functions.rules import load_deid_rules

    rules = [r for r in load_deid_rules() if not r.disabled]
    rnd = random.Random(4)
    compiled = deid._compiled(deid._spec(rules))
    pieces = [w for r in rules for w in re.findall(r"[A-Za-z]{2,}[ :.]?", r.pattern)] + ["Dr. ", "ſigned by: ", "King ", "12 ", "07123456789", "\n", " ", "EH1 2NG", "01/02/2003", "a@b.c", "Smith", "(", "No.: 12"]
    for _ in range(150):
        t = "".join(rnd.choice(pieces) for _ in range(60))
        want = [(r.rule_no, m.span()) for r in rules for m in re.finditer(r.pattern, t, r.re_flags())]
        assert [(no, m.span()) for no, _, _, m, _ in deid._rule_hits(t, compiled)] == want


def test_skipdoc_and_failing_rule(spark):
    from noteweave.functions.rules import DeidRule

    rules = [DeidRule(0, "a", r"name (\w+)", ["ignorecase"], ["name"], "n"), DeidRule(1, "b", r"(secret)", [], ["SKIPDOC"], "skip"),
             DeidRule(2, "c", r"(\w+)@", [], ["name"], "mail"), DeidRule(3, "d", r"(broken", [], ["name"], "x")]
    docs = spark.createDataFrame([(1, "[[Text]]Name Smith, joe@x"), (2, "[[Text]]name Smith, secret joe@x"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in deid.deidentify(docs, rules, ["Text"], []).collect()}
    assert [f.sent for f in out[1].findings] == ["Smith", "joe"] and out[1].deid_text == "[[Text]]\nName xxxxx, xxx@x"
    assert out[2].skipped and [f.sent for f in out[2].findings] == ["Smith"] and out[2].deid_text == deid.SKIP_TEXT
    assert all(len(r.errors) == 1 and r.errors[0].rule_no == 3 for r in out.values())
