"""Context rules on mentions (C3-C18): does the sentence context rule a mention out?

Inputs

* ``mentions(doc_id, ann_no, str, start_pos, end_pos, ...)``
* ``sentences(doc_id, sent_no, start_pos, end_pos)`` -- ``sent_no`` is the
  sentence's rank by start within its document (1-based)
* ``docs(doc_id, text)``

Plan shape (all joins are keyed; no per-document array is ever built):

1. C3 sentence of a mention -- a binned range join: each sentence is
   exploded over the fixed-size offset bins it covers, each mention looks up
   the bins of its start and end, so a huge document spreads over many keys.
   The first sentence by start wins.
2. C4 neighbours -- equi-joins on ``(doc_id, sent_no +- k)``, k = 1, 2.
3. Document-level rule inputs (C11 cut-off positions, C14 head of document)
   are computed once per document, then joined.
4. C5-C8 context strings and C9-C16 rule predicates are Column expressions;
   every rule file's patterns form one anchored alternation.

Offsets are code points, as in Python slicing.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import ContextConfig, ContextRule
from . import literals as L
from .sweep import sentence_of

HEAD_CHARS = 200
WINDOW_CHARS = 150




# ---------------------------------------------------------------- helpers

def py_slice(s: Column, a: Column | int | None = None, b: Column | int | None = None) -> Column:
    """Python ``s[a:b]`` for non-negative bounds (negative ones clamp to 0, X17)."""
    n = F.length(s)
    a_ = F.lit(0) if a is None else F.least(F.greatest(F.lit(a) if isinstance(a, int) else a, F.lit(0)), n)
    b_ = n if b is None else F.least(F.greatest(F.lit(b) if isinstance(b, int) else b, F.lit(0)), n)
    return F.when(b_ > a_, F.substring(s, a_ + 1, b_ - a_)).otherwise(F.lit(""))


def java_match(patterns: Sequence[str], case_sensitive: bool) -> str:
    """Python ``re.match`` on any of ``patterns`` as one Java regex.

    ``\\A(?:...)`` anchors at the start like ``match``; ``(?d)`` makes only
    ``\\n`` a line end (so ``$`` and ``.`` behave as in Python); ``(?U)``
    gives Unicode ``\\w \\s \\b`` and case folding as Python ``str`` patterns.
    """
    flags = "dU" + ("" if case_sensitive else "i")
    return f"(?{flags})\\A(?:" + "|".join(patterns) + ")"


def matches(text: Column, patterns: Sequence[str], case_sensitive: bool) -> Column:
    """``java_match`` on a text; one of ASCII characters only has no use for Unicode classes, which are much slower."""
    plain = "|".join(patterns)
    if not plain.isascii():
        return text.rlike(java_match(patterns, case_sensitive))
    ascii_form = f"(?d{'' if case_sensitive else 'i'})\\A(?:{plain})"
    return F.when(F.length(text) == F.octet_length(text), text.rlike(ascii_form)).otherwise(text.rlike(java_match(patterns, case_sensitive)))


#: Mentions of one document that share a copy of its text.
SHARED = 50_000
_SPANS = ("p", "n", "pp", "nn")


def _nearest(starts: Sequence[int], at: int) -> int | None:
    """The start nearest to a place; of two equally near ones the earlier."""
    k = bisect_left(starts, at)
    return min(starts[max(k - 1, 0): k + 1], key=lambda p: (abs(p - at), p), default=None)


def _part(text: str | None, a: int | None, b: int | None) -> str | None:
    """``text[a:b]`` with negative bounds at 0 (X17); null if anything is."""
    return None if text is None or a is None or b is None else text[max(a, 0): max(b, 0)]


def sentence_texts(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """Per mention ``offset`` and the texts of its sentence (``_ctx``) and of those around it, moved by the offset.

    Mentions have ``start_pos, end_pos, str, sent_start, sent_end`` and the spans of C4.  Texts and mentions are
    sorted together by document, each text before its mentions, and read in one stream: a task holds one text, and
    a mention leaves with its few sentences only.  A document of very many mentions is dealt to several tasks, with
    a copy of its text for every SHARED of them.

    C5: a mention whose text is not its string moves to the nearest whole-word occurrence of the string (ties: the
    earlier); without one, or if the place itself holds the string, it stays.  Mentions without sentences
    (no ``sent_start`` column) get the offset only, null where they stay.
    """
    from pyspark import cloudpickle
    from pyspark.sql.pandas.types import to_arrow_schema

    cloudpickle.register_pickle_by_value(L)
    many = mentions.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / SHARED).cast("int").alias("_n")).where("_n > 1")
    m = mentions.join(many, "doc_id", "left").withColumn("_part", F.pmod("ann_no", F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    d = docs.select("doc_id", "text").join(many, "doc_id", "left").select("doc_id", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)).alias("_part"), "text", F.lit(0).alias("_kind"))
    both = d.unionByName(m.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("doc_id", "_part").sortWithinPartitions("doc_id", "_part", "_kind")

    placed = "sent_start" in mentions.columns
    added = [T.StructField("offset", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("_ctx", "_prev", "_next", "_pp", "_nn") if placed)]
    needed = ["doc_id", "_part", "_kind", "start_pos", "end_pos", "str", *(["sent_start", "sent_end", *_SPANS] if placed else [])]
    schema = T.StructType([*mentions.schema.fields, *added])
    arrow, kept, find, nearest, part = to_arrow_schema(schema), mentions.columns, L, _nearest, _part

    def run(batches):
        key, text, low, places = None, None, None, {}
        for b in batches:
            out = []
            cols = {c: b.column(c).to_pylist() for c in needed}
            for k in range(len(b)):
                here = (cols["doc_id"][k], cols["_part"][k])
                if here != key:
                    key, text, low, places = here, None, None, {}
                if cols["_kind"][k] == 0:
                    text, low, places = b.column("text")[k].as_py(), None, {}
                    continue
                a, e, word = (cols[c][k] for c in ("start_pos", "end_pos", "str"))
                s0, s1 = (cols["sent_start"][k], cols["sent_end"][k]) if placed else (0, 0 if text is None else len(text))
                offset = 0 if placed else None
                if None not in (text, a, e, word, s0, s1) and part(text, a, e) != word and part(part(text, s0, s1), a - s0, e - s0).lower() != word.lower():
                    if word not in places:
                        low = find.fold(text) if low is None else low
                        x = find.fold(word)
                        places[word] = list(find._matches(text, find.find_all(low, [x]).get(x, ()), len(word), True))
                    to = nearest(places[word], a)
                    offset = offset if to is None else to - a
                if not placed:
                    out.append((k, offset))
                    continue
                spans = [cols[c][k] for c in _SPANS]
                own = [part(text, *(None if x is None else x + offset for x in (s0, s1)))]
                own += [None if x is None else part(text, *(None if y is None else y + offset for y in x.values())) for x in spans]
                out.append((k, offset, *own))
            rows, new = pa.array([r[0] for r in out], pa.int64()), list(zip(*out))[1:] or [()] * len(added)
            cols_out = [b.column(c).take(rows) for c in kept] + [pa.array(list(c), f.type) for c, f in zip(new, list(arrow)[len(kept):])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols_out, arrow)], schema=arrow)

    return both.mapInArrow(run, schema)


# ---------------------------------------------------------------- C3 / C4

def mention_sentence(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """``(doc_id, ann_no, sent_no)`` of the first sentence (by start) that
    holds the mention's start or end (both ends inclusive)."""
    return sentence_of(mentions, sentences)


def sentence_neighbours(sentences: DataFrame) -> DataFrame:
    """C4: each sentence with the spans of the sentences 2 and 1 before and after."""
    s = sentences.select("doc_id", "sent_no", "start_pos", "end_pos")
    nb = (s.withColumn("k", F.explode(F.array(F.lit(-2), F.lit(-1), F.lit(1), F.lit(2))))
          .select("doc_id", (F.col("sent_no") - F.col("k")).alias("sent_no"), "k",
                  F.struct("start_pos", "end_pos").alias("span")))
    g = nb.groupBy("doc_id", "sent_no").agg(
        *[F.max(F.when(F.col("k") == k, F.col("span"))).alias(n)
          for k, n in ((-2, "pp"), (-1, "p"), (1, "n"), (2, "nn"))])
    return s.join(g, ["doc_id", "sent_no"], "left")


# ---------------------------------------------------------------- C5-C8

def context_frame(mentions: DataFrame, sentences: DataFrame, docs: DataFrame,
                  cut_off_literals: Sequence[str] = (), head_rules: Sequence[ContextRule] = ()) -> DataFrame:
    """Per mention the strings the rules look at.

    ``head_rules`` (C14) are evaluated here, once per document; ``head_hits``
    holds their results in order.

    Columns added: ``sent_no``, ``offset`` (relocation delta, C5), ``str_orig``,
    ``s_before``, ``s_end`` (C6/C7), ``ctx_prev``/``ctx_next`` (C8, null when
    absent), ``head`` (C14), ``cut_pos`` (1-based first position of each
    cut-off literal in the lower-cased text, C11), ``found`` (false when no
    sentence holds the mention).
    """
    ms = mention_sentence(mentions, sentences)
    nbr = sentence_neighbours(sentences)
    lits = [F.locate(lit.lower(), F.lower(F.col("text"))) for lit in cut_off_literals]
    d = docs.select("doc_id",
                    py_slice(F.col("text"), 0, HEAD_CHARS).alias("head"),
                    (F.array(*lits) if lits else F.array().cast("array<int>")).alias("cut_pos"))
    hits = [F.coalesce(matches(F.col("head"), r.wrapped(), r.case_sensitive), F.lit(False)) for r in head_rules]
    d = d.withColumn("head_hits", F.array(*hits) if hits else F.array().cast("array<boolean>"))
    m = (mentions.join(ms, ["doc_id", "ann_no"], "left")
         .join(nbr.withColumnRenamed("start_pos", "sent_start").withColumnRenamed("end_pos", "sent_end"),
               ["doc_id", "sent_no"], "left"))
    m = sentence_texts(m, docs).join(d, "doc_id", "left").withColumn("found", F.col("sent_no").isNotNull())
    off_s, off_e = F.col("start_pos") - F.col("sent_start"), F.col("end_pos") - F.col("sent_start")
    ctx, prev, nxt = F.col("_ctx"), F.col("_prev"), F.col("_next")
    s_before0 = py_slice(ctx, None, off_s)
    # A previous sentence ending '?' or 'e.g.' joins the left context
    q_prev = prev.isNotNull() & (prev.endswith("?") | F.lower(prev).endswith("e.g."))
    s_before1 = F.when(q_prev, F.concat(prev, s_before0)).otherwise(s_before0)
    anchor1 = F.when(q_prev, F.lit(-1)).otherwise(F.lit(0))
    # a context starting with 's ' also pulls in the previous sentence
    s_start = ctx.startswith("s ") & prev.isNotNull()
    s_before = F.when(s_start, F.concat(prev, s_before1)).otherwise(s_before1)
    anchor2 = F.when(s_start, F.lit(-1)).otherwise(anchor1)
    # a context ending '?' takes the next sentence into the right context
    q_end = ctx.endswith("?") & nxt.isNotNull()
    s_end0 = py_slice(ctx, off_e, None)
    s_end = F.when(q_end, F.concat(s_end0, nxt)).otherwise(s_end0)
    anchor = F.when(q_end, F.lit(1)).otherwise(anchor2)
    m = m.withColumn("anchor", anchor)
    # The sentences before and after the anchor (for anchor -1 / +1 the
    # mention's own sentence is one of them)
    a = F.col("anchor")
    ctx_prev = F.when(a == -1, F.col("_pp")).when(a == 0, prev).otherwise(ctx)
    ctx_next = F.when(a == 1, F.col("_nn")).when(a == 0, nxt).otherwise(ctx)
    # The text at the (relocated) place; the annotation's string only where the two still differ
    moved = py_slice(F.col("_ctx"), off_s, off_e)
    str_orig = F.when(F.lower(moved) == F.lower(F.col("str")), moved).otherwise(F.col("str"))
    return (m.withColumn("s_before", s_before).withColumn("s_end", s_end)
            .withColumn("ctx_prev", ctx_prev).withColumn("ctx_next", ctx_next)
            .withColumn("str_orig", str_orig)
            .drop("_ctx", "_prev", "_next", "_pp", "_nn", "p", "n", "pp", "nn", "sent_start", "sent_end"))


# ---------------------------------------------------------------- C9-C17

def _rule_compare(rule: ContextRule) -> Column:
    if rule.offset == 0:
        base = F.col("head")
    elif rule.offset == 100:
        base = F.col("str_orig")
    elif rule.offset > 0:
        base = F.col("s_end")
    else:
        base = F.col("s_before")
    if rule.offset not in (0, 100, -100) and rule.more_context_sents:
        if -1 in rule.more_context_sents:
            base = F.when(F.col("ctx_prev").isNotNull(), F.concat_ws(" ", F.col("ctx_prev"), base)).otherwise(base)
        if 1 in rule.more_context_sents:
            base = F.when(F.col("ctx_next").isNotNull(), F.concat_ws(" ", base, F.col("ctx_next"))).otherwise(base)
    return base


def rule_hit(rule: ContextRule) -> Column:
    """Whether any pattern of one list rule matches its context."""
    return F.coalesce(matches(_rule_compare(rule), rule.wrapped(), rule.case_sensitive), F.lit(False))


def verdict(cfg: ContextConfig, cut_rules: Sequence[tuple[ContextRule, list[int]]]) -> Column:
    """``ruled_by`` with precedence original-string > skip terms > cut-off > rule list."""
    list_rules = [r for r in cfg.rules if r.offset != -100]
    heads = head_rules(cfg)
    names = [F.when(F.col("head_hits")[heads.index(r)] if r in heads else rule_hit(r), F.lit(r.name)) for r in list_rules]
    listed = F.array_distinct(F.filter(F.array(*names), lambda x: x.isNotNull())) if names \
        else F.array().cast("array<string>")
    out = listed
    # C11: first cut-off rule (in order) with a literal at 0 < pos <= start (pos 0 does not count, X18)
    start0 = F.col("start_pos") + F.col("offset")
    for rule, idx in reversed(cut_rules):
        fired = F.lit(False)
        for i in idx:
            p = F.col("cut_pos")[i]
            fired = fired | ((p >= 2) & (p <= start0 + 1))
        out = F.when(fired, F.array(F.lit(rule.name))).otherwise(out)
    if cfg.skip_terms:  # C10 (checked even without filter rules, X3)
        sk = F.array(*[F.lit(s.lower()) for s in cfg.skip_terms])
        out = F.when(F.array_contains(sk, F.lower(F.col("str_orig"))), F.array(F.lit("skip terms"))).otherwise(out)
    if cfg.osf_patterns:  # C9
        hit = F.col("str_orig").rlike("(?dU)\\A(?:" + "|".join(cfg.osf_patterns) + ")")
        out = F.when(hit, F.array(F.lit("original-string-rule"))).otherwise(out)
    return out


def head_rules(cfg: ContextConfig) -> list[ContextRule]:
    """C14: the list rules that look at the head of the document."""
    return [r for r in cfg.rules if r.offset == 0]


def cut_off_plan(cfg: ContextConfig) -> tuple[list[str], list[tuple[ContextRule, list[int]]]]:
    lits: list[str] = []
    plan = []
    for r in cfg.rules:
        if r.offset == -100:
            idx = []
            for lit in r.regs:
                idx.append(len(lits))
                lits.append(lit)
            plan.append((r, idx))
    return lits, plan


def apply_context_rules(mentions: DataFrame, sentences: DataFrame, docs: DataFrame, cfg: ContextConfig,
                        in_scope: Column | None = None) -> DataFrame:
    """Add ``ruled_by`` (and the context columns) to every mention in scope.

    ``in_scope`` (C17) selects the mentions that are ruled (e.g. study
    mentions): only they are joined with sentences and texts.  The others, and
    mentions with no sentence, keep their list (empty if they had none); the
    others' context columns are null.
    """
    old = F.col("ruled_by") if "ruled_by" in mentions.columns else F.array().cast("array<string>")
    if in_scope is not None:
        scope = F.coalesce(in_scope, F.lit(False))
        rest = mentions.where(~scope).withColumn("ruled_by", old)
        return apply_context_rules(mentions.where(scope), sentences, docs, cfg).unionByName(rest, allowMissingColumns=True)
    lits, plan = cut_off_plan(cfg)
    c = context_frame(mentions, sentences, docs, lits, head_rules(cfg))
    rb = verdict(cfg, plan)
    return c.withColumn("ruled_by", F.when(F.col("found"), F.array_distinct(F.concat(old, rb))).otherwise(old))


def char_window_rules(mentions: DataFrame, docs: DataFrame, cfg: ContextConfig,
                      window: int = WINDOW_CHARS) -> DataFrame:
    """150 characters either side instead of sentences; the last matching
    rule's name wins (cut-off rules are not part of this variant)."""
    d = docs.select("doc_id", "text")
    m = mentions.join(d, "doc_id", "left")
    t = F.col("text")
    a_s, a_e = F.col("start_pos"), F.col("end_pos")
    m = (m.withColumn("s_before", py_slice(t, a_s - window, a_s))
         .withColumn("s_end", py_slice(t, a_e, a_e + window))
         .withColumn("head", py_slice(t, 0, HEAD_CHARS))
         .withColumn("str_orig", py_slice(t, a_s, a_e))
         .withColumn("ctx_prev", F.lit(None).cast("string")).withColumn("ctx_next", F.lit(None).cast("string")))
    name = F.lit(None).cast("string")
    for r in cfg.rules:
        if r.offset == -100:
            continue
        plain = ContextRule(r.name, r.offset, r.regs, r.case_sensitive, r.containing, [])
        name = F.when(rule_hit(plain), F.lit(r.name)).otherwise(name)
    return m.withColumn("rule_name", name)
