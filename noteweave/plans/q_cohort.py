"""Registered queries: study concepts (K*) and cohort roll-ups (A*) over F1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort, study
from . import inputs
from .registry import register

_TYPES_SQL = ", ".join(f"'{t}'" for t in inputs.COHORT_TYPES)

# K7 in SQL: keep each cui only in its highest-ord concept
_DISJOINT_SQL = """sd as (select s.ord, s.name, s.cui from f_study s
  join (select cui, max(ord) as mo from f_study group by cui) m on s.cui = m.cui and s.ord = m.mo)"""

_MENTIONS_SQL = f"""{_DISJOINT_SQL},
mm as (select a.doc_id, a.ann_no, a.cui, a.pref, sd.name as concept, d.patient_id
  from f_ann a join sd on a.cui = sd.cui join f_doc d on a.doc_id = d.doc_id
  where a.sty in ({_TYPES_SQL}) and a.negation = 'Affirmed' and a.experiencer = 'Patient' and a.ruled_by = '')"""


def _cohort_mentions(spark, sf_dir):
    """K7 -> K11 -> A1 -> A4: positive, unruled study mentions with their patient."""
    anns = inputs.annotations(spark, sf_dir)
    concepts = study.disjoint_concepts(inputs.study(spark, sf_dir))
    tagged = study.tag_mentions(anns, concepts, keep_untagged=False)
    chosen = cohort.select_cohort_mentions(tagged, inputs.COHORT_TYPES)
    matched, _unmatched = cohort.map_to_patients(chosen, inputs.documents(spark, sf_dir))
    return matched.withColumn("concept", F.col("study_concepts")[0])


@register("cohort_patient_concept", f"""with {_MENTIONS_SQL},
lbl as (select cui, pref as label from (select cui, pref, row_number() over (partition by cui order by doc_id, ann_no) as rn from mm) where rn = 1)
select c.patient_id, c.cui, lbl.label, c.n, c.concept
from (select patient_id, cui, concept, count(*) as n from mm group by patient_id, cui, concept) c join lbl on c.cui = lbl.cui""")
def cohort_patient_concept(spark, sf_dir):
    """Patients by concept counts for affirmed, unruled mentions of the study concepts."""
    return cohort.patient_concept_graph(_cohort_mentions(spark, sf_dir), ("concept",))


@register("study_disjoint", f"""with {_DISJOINT_SQL}
select name, ord, count(*) as n_cuis, min(cui) as first_cui, max(cui) as last_cui from sd group by name, ord""")
def study_disjoint(spark, sf_dir):
    """K7: size and CUI range of each concept after making closures disjoint."""
    d = study.disjoint_concepts(inputs.study(spark, sf_dir))
    return d.groupBy("name", "ord").agg(F.count(F.lit(1)).alias("n_cuis"),
                                        F.min("cui").alias("first_cui"), F.max("cui").alias("last_cui"))


@register("study_overlap", """
select i.name as concept_i, j.name as concept_j, cast(i.ord as int) as ord_i, cast(j.ord as int) as ord_j, count(*) as n_common
from f_study i join f_study j on i.cui = j.cui and i.ord > j.ord
where not exists (select 1 from f_study k where k.cui = i.cui and k.ord > j.ord and k.ord < i.ord)
group by i.name, j.name, i.ord, j.ord""")
def study_overlap(spark, sf_dir):
    """K8: CUIs removed from concept j because the later concept i holds them."""
    o = study.overlap_sizes(inputs.study(spark, sf_dir))
    return o.select("concept_i", "concept_j", F.col("ord_i").cast("int").alias("ord_i"),
                    F.col("ord_j").cast("int").alias("ord_j"), "n_common")


@register("study_tag", """
select a.doc_id, a.ann_no, a.cui, coalesce(t.names, '') as study_concepts from f_ann a
left join (select cui, string_agg(name, '|' order by ord) as names from f_study group by cui) t on a.cui = t.cui""")
def study_tag(spark, sf_dir):
    """K11 without K7: every concept holding the CUI, in study order."""
    tagged = study.tag_mentions(inputs.annotations(spark, sf_dir), inputs.study(spark, sf_dir))
    return tagged.select("doc_id", "ann_no", "cui", inputs.joined("study_concepts"))


@register("study_concept_lists", """
select name, cast(ord as int) as ord, string_agg(cui, ',' order by cui) as cuis, count(*) as n from f_study group by name, ord""")
def study_concept_lists(spark, sf_dir):
    """K9: concept -> sorted CUI list."""
    c = study.concept_lists(inputs.study(spark, sf_dir))
    return c.select("name", F.col("ord").cast("int").alias("ord"), F.array_join("cuis", ",").alias("cuis"),
                    F.size("cuis").cast("long").alias("n"))


@register("study_term_labels", """
select name, cui, case when count(*) over (partition by name) > 1
  then '(' || name || ') ' || cui || ' (' || cast(row_number() over (partition by name order by cui) as varchar) || ')'
  else '(' || name || ') ' || cui end as label from f_study""")
def study_term_labels(spark, sf_dir):
    """Merged term-mapping labels."""
    return study.term_labels(inputs.study(spark, sf_dir))


_WIDE_NAMES = ["even_key", "key_div3", "low_key"]


@register("cohort_wide", f"""with {_MENTIONS_SQL}
select patient_id,
 count(*) filter (where concept = 'even_key') as even_key,
 count(*) filter (where concept = 'key_div3') as key_div3,
 count(*) filter (where concept = 'low_key') as low_key
from mm group by patient_id""")
def cohort_wide(spark, sf_dir):
    """Patient x concept counts, one column per study concept."""
    return cohort.patient_concept_wide(_cohort_mentions(spark, sf_dir), _WIDE_NAMES)


@register("cohort_samples", f"""with {_MENTIONS_SQL}
select concept, patient_id, doc_id, sample_no from (
 select concept, patient_id, doc_id, cast(row_number() over (partition by concept order by patient_id) as int) as sample_no
 from (select concept, patient_id, min(doc_id) as doc_id from mm group by concept, patient_id)) where sample_no <= 20""")
def cohort_samples(spark, sf_dir):
    """A10: first doc of up to 20 positive patients per concept."""
    s = cohort.concept_samples(_cohort_mentions(spark, sf_dir), 20)
    return s.select("concept", "patient_id", "doc_id", F.col("sample_no").cast("int").alias("sample_no"))


@register("sty_counts", """
select doc_id, sty, count(*) as n from f_ann group by rollup (doc_id, sty)""")
def sty_counts(spark, sf_dir):
    """Annotations per document and semantic type, with totals."""
    return cohort.sty_counts(inputs.annotations(spark, sf_dir))


@register("cohort_grouped_wide", f"""with {_MENTIONS_SQL}
select split_part(d.modalities, '|', 1) as grp, mm.patient_id,
 count(*) filter (where concept = 'even_key') as even_key,
 count(*) filter (where concept = 'key_div3') as key_div3,
 count(*) filter (where concept = 'low_key') as low_key
from mm join f_doc d on mm.doc_id = d.doc_id group by split_part(d.modalities, '|', 1), mm.patient_id""")
def cohort_grouped_wide(spark, sf_dir):
    """Patient x concept counts split by a group key (the document's first modality)."""
    m = _cohort_mentions(spark, sf_dir)
    grp = inputs.documents(spark, sf_dir).select("doc_id", F.split("modalities", r"\|")[0].alias("grp"))
    return cohort.grouped_wide(m.join(grp, "doc_id"), _WIDE_NAMES, "grp")


@register("study_retained", """select ord, name, cui from f_study where name in ('low_key', 'key_div3')""")
def study_retained(spark, sf_dir):
    """K5: keep only the listed study concepts (left-semi join on the name list)."""
    names = spark.createDataFrame([("low_key",), ("key_div3",)], "name string")
    return study.retain_concepts(inputs.study(spark, sf_dir), names).select("ord", "name", "cui")


@register("doc_ids_from_names", """select page_id, regexp_extract(url, '(?i)/EN/([0-9]+)', 1) as doc_id from pages
 where regexp_extract(url, '(?i)/EN/([0-9]+)', 1) <> ''""")
def doc_ids_from_names(spark, sf_dir):
    """A3: document id from a file/page name by regex group 1 (case-insensitive);
    names that do not match are ignored."""
    p = inputs.base(spark, sf_dir, "pages").select("page_id", "url")
    d = p.select("page_id", cohort.doc_id_from_path(F.col("url"), "/EN/([0-9]+)").alias("doc_id"))
    return d.where(F.col("doc_id").isNotNull())
