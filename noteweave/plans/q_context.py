"""Registered queries: context rules (C3-C18) over the F4 notes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.rules import ContextConfig, load_context_config
from ..operators import context
from . import inputs
from .registry import register

ACTIVE = ["cris_document_filters.json", "hypothetical_filters.json", "negation_filters.json",
          "not_mention_filters.json", "other_experiencer_filters.json", "s_abbr.json",
          "cris_cutoff_filters.json"]
SKIP = "general_cris_skip_terms.json"


def _frames(spark, sf_dir):
    note = inputs.view(spark, sf_dir, "f_note")
    return (inputs.view(spark, sf_dir, "f_note_ann"), inputs.view(spark, sf_dir, "f_note_sent"),
            note.select("doc_id", "text"))


# ---------------------------------------------------------------- SQL side

def _sl(t: str, a: str | None, b: str | None) -> str:
    """SQL for Python t[a:b] with bounds clamped to [0, len]."""
    n = f"length({t})"
    a_ = "0" if a is None else f"least(greatest({a}, 0), {n})"
    b_ = n if b is None else f"least(greatest({b}, 0), {n})"
    return f"(case when {b_} > {a_} then substr({t}, {a_} + 1, {b_} - {a_}) else '' end)"


def _wc(ch: str) -> str:
    return f"coalesce(regexp_matches({ch}, '^\\w$'), false)"


_CTX_SQL = f"""
ann as (select doc_id, ann_no, str, start_pos, end_pos from f_note_ann),
sent as (select doc_id, sent_no, start_pos, end_pos from f_note_sent),
doc as (select doc_id, text from f_note),
ms as (select a.doc_id, a.ann_no, arg_min(s.sent_no, s.start_pos) as sent_no from ann a join sent s on a.doc_id = s.doc_id
  and (a.start_pos between s.start_pos and s.end_pos or a.end_pos between s.start_pos and s.end_pos) group by a.doc_id, a.ann_no),
base as (select a.*, d.text, ms.sent_no, s.start_pos as ss, s.end_pos as se,
  p.start_pos as ps, p.end_pos as pe, n.start_pos as ns, n.end_pos as ne,
  pp.start_pos as pps, pp.end_pos as ppe, nn.start_pos as nns, nn.end_pos as nne
  from ann a join doc d on a.doc_id = d.doc_id left join ms on a.doc_id = ms.doc_id and a.ann_no = ms.ann_no
  left join sent s on s.doc_id = a.doc_id and s.sent_no = ms.sent_no
  left join sent p on p.doc_id = a.doc_id and p.sent_no = ms.sent_no - 1
  left join sent n on n.doc_id = a.doc_id and n.sent_no = ms.sent_no + 1
  left join sent pp on pp.doc_id = a.doc_id and pp.sent_no = ms.sent_no - 2
  left join sent nn on nn.doc_id = a.doc_id and nn.sent_no = ms.sent_no + 2),
occ0 as (select doc_id, ann_no, str, text, unnest(range(1, length(text) - length(str) + 2)) as i from base where length(str) > 0),
occ as (select doc_id, ann_no, i - 1 as pos from occ0
  where lower(substr(text, i, length(str))) = lower(str)
    and {_wc("substr(str, 1, 1)")} <> (case when i > 1 then {_wc("substr(text, i - 1, 1)")} else false end)
    and {_wc("substr(str, length(str), 1)")} <> {_wc("substr(text, i + length(str), 1)")}),
b2 as (select b.*, {_sl(_sl("b.text", "b.ss", "b.se"), "b.start_pos - b.ss", "b.end_pos - b.ss")} as in_sent from base b),
b3 as (select b2.*, (lower(in_sent) <> lower(str) and {_sl("text", "start_pos", "end_pos")} <> str) as mismatch,
  (select arg_min(o.pos, abs(o.pos - b2.start_pos) * 100000000 + o.pos) from occ o where o.doc_id = b2.doc_id and o.ann_no = b2.ann_no) as best
  from b2),
b4 as (select b3.*, case when mismatch and best is not null then best - start_pos else 0 end as off from b3),
b5 as (select b4.*, {_sl("text", "ss + off", "se + off")} as ctx,
  case when ps is not null then {_sl("text", "ps + off", "pe + off")} end as prv,
  case when ns is not null then {_sl("text", "ns + off", "ne + off")} end as nxt,
  case when pps is not null then {_sl("text", "pps + off", "ppe + off")} end as pprv,
  case when nns is not null then {_sl("text", "nns + off", "nne + off")} end as nnxt from b4),
b6 as (select b5.*, {_sl("ctx", None, "start_pos - ss")} as sb0, {_sl("ctx", "end_pos - ss", None)} as se0,
  (prv is not null and (prv like '%?' or lower(prv) like '%e.g.')) as q_prev,
  (ctx like 's %' and prv is not null) as s_st, (ctx like '%?' and nxt is not null) as q_end from b5),
b7 as (select b6.*,
  case when s_st then prv else '' end || case when q_prev then prv else '' end || sb0 as s_before,
  se0 || case when q_end then nxt else '' end as s_end,
  case when q_end then 1 when s_st or q_prev then -1 else 0 end as anchor from b6),
ctx as (select doc_id, ann_no, sent_no, start_pos, off, s_before, s_end,
  case anchor when -1 then pprv when 0 then prv else ctx end as ctx_prev,
  case anchor when 1 then nnxt when 0 then nxt else ctx end as ctx_next,
  case when lower({_sl("ctx", "start_pos - ss", "end_pos - ss")}) = lower(str) then {_sl("ctx", "start_pos - ss", "end_pos - ss")} else str end as str_orig,
  {_sl("text", None, "200")} as head, lower(text) as ltext, sent_no is not null as found from b7)
"""


def _java_to_re2(p: str) -> str:
    return p.replace("'", "''")


def _rule_sql(rule) -> str:
    if rule.offset == 0:
        base = "head"
    elif rule.offset == 100:
        base = "str_orig"
    elif rule.offset > 0:
        base = "s_end"
    else:
        base = "s_before"
    if rule.offset not in (0, 100, -100) and rule.more_context_sents:
        if -1 in rule.more_context_sents:
            base = f"(case when ctx_prev is not null then ctx_prev || ' ' || {base} else {base} end)"
        if 1 in rule.more_context_sents:
            base = f"(case when ctx_next is not null then {base} || ' ' || ctx_next else {base} end)"
    pat = "^(?:" + "|".join(rule.wrapped()) + ")"
    return f"coalesce(regexp_matches({base}, '{_java_to_re2(pat)}', '{'c' if rule.case_sensitive else 'i'}'), false)"


def _verdict_sql(cfg: ContextConfig) -> str:
    names: list[str] = []
    hits: dict[str, list[str]] = {}
    for r in cfg.rules:
        if r.offset == -100:
            continue
        if r.name not in hits:
            names.append(r.name)
            hits[r.name] = []
        hits[r.name].append(_rule_sql(r))
    listed = "concat_ws('|', " + ", ".join(
        f"case when {' or '.join(hits[n])} then '{n}' end" for n in names) + ")" if names else "''"
    out = listed
    for r in reversed([r for r in cfg.rules if r.offset == -100]):
        conds = " or ".join(f"(strpos(ltext, '{lit.lower()}') between 2 and start_pos + off + 1)" for lit in r.regs)
        out = f"case when {conds} then '{r.name}' else {out} end"
    if cfg.skip_terms:
        sk = ", ".join("'" + s.lower().replace("'", "''") + "'" for s in cfg.skip_terms)
        out = f"case when lower(str_orig) in ({sk}) then 'skip terms' else {out} end"
    return f"case when found then {out} else '' end"


def _rule_query(name: str, active: list[str], skip: str | None):
    cfg = load_context_config(active, skip)
    sql = f"with {_CTX_SQL} select doc_id, ann_no, {_verdict_sql(cfg)} as ruled_by from ctx"

    def fn(spark, sf_dir):
        anns, sents, docs = _frames(spark, sf_dir)
        r = context.apply_context_rules(anns, sents, docs, cfg)
        return r.select("doc_id", "ann_no", F.array_join("ruled_by", "|").alias("ruled_by"))
    fn.__name__ = name
    fn.__doc__ = f"C9-C17 with rules {', '.join(active)}" + (f" and skip terms {skip}" if skip else "") + "."
    register(name, sql)(fn)


_rule_query("rule_negation", ["negation_filters.json"], None)
_rule_query("rule_hypothetical", ["hypothetical_filters.json"], None)
_rule_query("rule_experiencer", ["other_experiencer_filters.json"], None)
_rule_query("rule_not_mention", ["not_mention_filters.json"], None)
_rule_query("rule_head", ["cris_document_filters.json"], None)
_rule_query("rule_cutoff", ["cris_cutoff_filters.json"], None)
_rule_query("rule_skip", [], SKIP)
_rule_query("rule_abbrev", ["s_abbr.json"], None)
_rule_query("rule_verdict", ACTIVE, SKIP)


_NEG_CFG = load_context_config(["negation_filters.json"], None)


@register("rule_scope", f"""with {_CTX_SQL}
select doc_id, ann_no, case when doc_id % 3 = 0 then {_verdict_sql(_NEG_CFG)} else '' end as ruled_by from ctx""")
def rule_scope(spark, sf_dir):
    """C17: only the mentions of every third document are ruled; the others keep an empty list."""
    anns, sents, docs = _frames(spark, sf_dir)
    r = context.apply_context_rules(anns, sents, docs, _NEG_CFG, in_scope=F.col("doc_id") % 3 == 0)
    return r.select("doc_id", "ann_no", F.array_join("ruled_by", "|").alias("ruled_by"))


_OSF = ["[A-Z]{3}$", "red\\b"]
_OSF_CFG = replace(_NEG_CFG, osf_patterns=_OSF)


@register("rule_original_string", f"""with {_CTX_SQL}
select doc_id, ann_no, case when found and regexp_matches(str_orig, '^(?:{"|".join(_OSF)})') then 'original-string-rule'
  else {_verdict_sql(_NEG_CFG)} end as ruled_by from ctx""")
def rule_original_string(spark, sf_dir):
    """Patterns over the mention's own string come before all other rules."""
    anns, sents, docs = _frames(spark, sf_dir)
    r = context.apply_context_rules(anns, sents, docs, _OSF_CFG)
    return r.select("doc_id", "ann_no", F.array_join("ruled_by", "|").alias("ruled_by"))


@register("sentence_of_mention", f"with {_CTX_SQL} select b.doc_id, b.ann_no, b.sent_no, b.ps is not null as has_prev, b.ns is not null as has_next from base b")
def sentence_of_mention(spark, sf_dir):
    """The mention's sentence and whether it has neighbours."""
    anns, sents, _docs = _frames(spark, sf_dir)
    ms = context.mention_sentence(anns, sents)
    nb = context.sentence_neighbours(sents)
    r = anns.select("doc_id", "ann_no").join(ms, ["doc_id", "ann_no"], "left").join(nb, ["doc_id", "sent_no"], "left")
    return r.select("doc_id", "ann_no", "sent_no", F.col("p").isNotNull().alias("has_prev"),
                    F.col("n").isNotNull().alias("has_next"))


@register("context_windows", f"""with {_CTX_SQL}
select doc_id, ann_no, cast(off as int) as offset, s_before, s_end, ctx_prev, ctx_next, str_orig from ctx""")
def context_windows(spark, sf_dir):
    """Relocation offset and the left/right/extra contexts of each mention."""
    anns, sents, docs = _frames(spark, sf_dir)
    c = context.context_frame(anns, sents, docs)
    return c.select("doc_id", "ann_no", F.col("offset").cast("int").alias("offset"), "s_before", "s_end",
                    "ctx_prev", "ctx_next", "str_orig")


@register("relocate", f"""with {_CTX_SQL}
select doc_id, ann_no, cast(start_pos + off as int) as start_pos, cast(off as int) as offset from ctx""")
def relocate(spark, sf_dir):
    """Mentions whose text does not match their offsets move to the nearest whole-word occurrence."""
    anns, sents, docs = _frames(spark, sf_dir)
    c = context.context_frame(anns, sents, docs)
    return c.select("doc_id", "ann_no", (F.col("start_pos") + F.col("offset")).cast("int").alias("start_pos"),
                    F.col("offset").cast("int").alias("offset"))


def _cw_sql(cfg: ContextConfig) -> str:
    expr = "cast(null as varchar)"
    for r in cfg.rules:
        if r.offset == -100:
            continue
        from ..functions.rules import ContextRule
        plain = ContextRule(r.name, r.offset, r.regs, r.case_sensitive, r.containing, [])
        expr = f"case when {_rule_sql(plain)} then '{r.name}' else {expr} end"
    return f"""with a as (select n.doc_id, f.ann_no, f.start_pos, f.end_pos, n.text from f_note_ann f join f_note n on f.doc_id = n.doc_id),
w as (select doc_id, ann_no, {_sl('text', 'start_pos - 150', 'start_pos')} as s_before, {_sl('text', 'end_pos', 'end_pos + 150')} as s_end,
  {_sl('text', None, '200')} as head, {_sl('text', 'start_pos', 'end_pos')} as str_orig from a)
select doc_id, ann_no, {expr} as rule_name from w"""


_CW_CFG = load_context_config(ACTIVE, SKIP)


@register("char_window_rules", _cw_sql(_CW_CFG))
def char_window_rules(spark, sf_dir):
    """150-character windows instead of sentences; last matching rule wins."""
    anns, _sents, docs = _frames(spark, sf_dir)
    return context.char_window_rules(anns, docs, _CW_CFG).select("doc_id", "ann_no", "rule_name")
