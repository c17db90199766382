"""Registered queries: display derivations (V*) over F1 and F4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import display
from . import inputs
from .registry import register


@register("effective_flags", """select doc_id, ann_no,
 case when ruled_by = 'positive_filters.json' then 'Affirmed'
      when negation = 'Negated' or ruled_by = 'negation_filters.json' then 'Negated' else 'Affirmed' end as eff_negation,
 case when experiencer <> 'Patient' or ruled_by = 'other_experiencer_filters.json' then 'Other' else '' end as eff_experiencer,
 case when temporality = 'hypothetical' or ruled_by = 'hypothetical_filters.json' then 'hypo' else '' end as hypothetical,
 case when ruled_by = 's_abbr.json' then 'abbrev' else '' end as abbrev
from f_ann""")
def effective_flags(spark, sf_dir):
    """V1/V2: effective negation / experiencer / hypothetical / abbreviation flags."""
    f = display.effective_flags(inputs.annotations(spark, sf_dir))
    return f.select("doc_id", "ann_no", "eff_negation", "eff_experiencer", "hypothetical", "abbrev")


def _overlap_sql(src: str) -> str:
    return f"""v as ({src}),
pairs as (select x.doc_id, x.idx as anchor, y.idx as m_idx, y.s as m_s, y.e as m_e from v x join v y on x.doc_id = y.doc_id
  and (y.s > x.s or (y.s = x.s and y.idx > x.idx)) and y.s < x.e),
grp as (select * from pairs union all
  select distinct p.doc_id, p.anchor, p.anchor, v.s, v.e from pairs p join v on v.doc_id = p.doc_id and v.idx = p.anchor),
ranked as (select *, row_number() over (partition by doc_id, anchor order by m_e - m_s desc, m_s desc, m_idx desc) as rk from grp),
removed as (select distinct doc_id, m_idx as idx from ranked where rk > 1),
kept as (select * from v where not exists (select 1 from removed r where r.doc_id = v.doc_id and r.idx = v.idx))"""


@register("overlap_longest", f"""with {_overlap_sql('select doc_id, ann_no as idx, start_pos as s, end_pos as e from f_ann')}
select doc_id, idx as ann_no from kept""")
def overlap_longest(spark, sf_dir):
    """V3 + V4: unified view with overlapping annotations reduced to the longest."""
    v = display.unify(inputs.annotations(spark, sf_dir))
    return display.remove_overlaps(v).select("doc_id", F.col("idx").alias("ann_no"))


_NOTE_VIEW = ("select doc_id, ann_no as idx, start_pos as s, end_pos as e, 'Finding' as t, upper(str) as label "
              "from f_note_ann")


@register("snippet", f"""with {_overlap_sql(_NOTE_VIEW)},
first as (select doc_id, arg_min(idx, s * 1000000 + idx) as idx from kept group by doc_id),
f as (select k.* from kept k join first using (doc_id, idx)),
d as (select n.doc_id, n.text, f.s, f.e, f.t, f.label, case when f.s > 20 then f.s - 20 else f.s end as pv,
  least(f.e + 20, length(n.text)) as en from f_note n left join f on n.doc_id = f.doc_id)
select doc_id, case when s is null then substr(text, 1, 20) || '...' else
  (case when pv > 0 then '...' else '' end) || substr(text, pv + 1, s - pv)
  || '<mark class=''default umls Affirmed Recent   ''><span title=''' || t || ''' class="ann">' || label || ' | ' || t
  || '</span>' || substr(text, s + 1, e - s) || '</mark>' || substr(text, e + 1, en - e)
  || case when en < length(text) then '...' else '' end end as snippet from d""")
def snippet(spark, sf_dir):
    """V3 + V4 + V5: marked-up snippet around each note's first mention."""
    a = inputs.view(spark, sf_dir, "f_note_ann")
    v = a.select("doc_id", F.col("ann_no").alias("idx"), F.col("start_pos").alias("s"), F.col("end_pos").alias("e"),
                 F.lit("Finding").alias("t"), F.upper("str").alias("label"), F.lit("Affirmed").alias("negation"),
                 F.lit("Patient").alias("experiencer"), F.lit("Recent").alias("temporality"),
                 F.array().cast("array<string>").alias("ruled_by"), F.lit("umls").alias("category"))
    return display.snippet(v, inputs.view(spark, sf_dir, "f_note"))
