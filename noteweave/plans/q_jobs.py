"""Registered queries: raw NLP JSON loading (S3-S5, S12), sentence spans (J6),
gazetteer mentions (J5) and the incremental window filter (J1)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.partitioning import spread
from ..operators import jobs
from ..sources import nlp_json
from ..streaming.incremental import JobStatus, next_window, window_filter
from ..sources.fixtures import cui_sql
from . import inputs
from .registry import register


def _node(off):
    return F.concat(F.lit('{"id":0,"offset":'), off.cast("string"), F.lit("}"))


def _obj(kind, id_, s, e, feats):
    return F.concat(F.lit('{"type":"'), F.lit(kind), F.lit('","id":'), F.lit(str(id_)), F.lit(',"startNode":'), _node(s),
                    F.lit(',"endNode":'), _node(e), F.lit(',"features":{'), feats, F.lit("}}"))


def raw_lines(note):
    """each note as one A4 JSON line: sentences in reverse order, a mention
    (offsets +2 for every sixth note, a broken quote in string_orig for every
    tenth), a phenotype for tid % 4 = 0 and an object of unknown type, spread
    over two inner arrays."""
    shift = F.when(F.col("doc_id") % 6 == 0, F.lit(2)).otherwise(F.lit(0))
    sval = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit('Q"'), F.col("mention"))).otherwise(F.col("mention"))
    m_feats = F.concat(F.lit('"string_orig":"'), sval, F.lit('","inst":"C'), F.lpad(F.col("tid").cast("string"), 7, "0"),
                       F.lit('","PREF":"'), F.upper("mention"),
                       F.lit('","STY":"Finding","Negation":"Affirmed","Temporality":"Recent","Experiencer":"Patient"'))
    p_feats = F.concat(F.lit('"string_orig":"'), F.col("mention"), F.lit('","majorType":"phenotype","minorType":"tid_'),
                       F.col("tid").cast("string"),
                       F.lit('","Negation":"Affirmed","Temporality":"Recent","Experiencer":"Patient"'))
    mention = _obj("Mention", 10, F.col("m_start") + shift, F.col("m_end") + shift, m_feats)
    pheno = F.when(F.col("tid") % 4 == 0, F.concat(_obj("Phenotype", 11, F.col("m_start"), F.col("m_end"), p_feats),
                                                   F.lit(","))).otherwise(F.lit(""))
    s = [_obj("Sentence", k, F.col(f"s{k}"), F.col(f"e{k}"), F.lit("")) for k in (0, 1, 2)]
    other = _obj("Token", 12, F.lit(0), F.lit(3), F.lit(""))
    line = F.concat(F.lit('{"docId":"'), F.col("doc_id").cast("string"), F.lit('","annotations":[['),
                    s[2], F.lit(","), s[1], F.lit(","), mention, F.lit("],["), s[0], F.lit(","), pheno, other,
                    F.lit("]]}"))
    return note.select(line.alias("value"))


@register("raw_json_load", """
select cast(doc_id as varchar) as doc_id, 'Mention' as kind, 'cui-1' as id,
  cast(m_start + case when doc_id % 6 = 0 then 2 else 0 end as int) as start_pos,
  cast(m_end + case when doc_id % 6 = 0 then 2 else 0 end as int) as end_pos,
  case when doc_id % 10 = 0 then 'Q"' || mention else mention end as str from f_note
union all select cast(doc_id as varchar), 'Phenotype', 'phe-1', m_start, m_end, mention from f_note where tid % 4 = 0
union all select cast(doc_id as varchar), 'Sentence', 'sent-1', s2, e2, cast(3 as varchar) from f_note
union all select cast(doc_id as varchar), 'Sentence', 'sent-2', s1, e1, cast(2 as varchar) from f_note
union all select cast(doc_id as varchar), 'Sentence', 'sent-3', s0, e0, cast(1 as varchar) from f_note""")
def raw_json_load(spark, sf_dir):
    """S4 + S12 + S5: parse JSON lines (repairing broken quotes), then typed rows with
    encounter-order ids; sentences ranked by start (rank in ``str``)."""
    docs, _bad = nlp_json.parse_lines(raw_lines(spread(inputs.view(spark, sf_dir, "f_note"))))
    rows = nlp_json.annotation_rows(docs)
    shown = F.when(F.col("kind") == "Sentence", F.col("ann_no").cast("string")).otherwise(F.col("str"))
    return rows.select("doc_id", "kind", "id", "start_pos", "end_pos", shown.alias("str"))


@register("raw_json_quarantine", "select 0 as n_quarantined")
def raw_json_quarantine(spark, sf_dir):
    """Lines still malformed after the repair (none expected)."""
    _docs, bad = nlp_json.parse_lines(raw_lines(inputs.view(spark, sf_dir, "f_note")))
    return bad.agg(F.count(F.lit(1)).cast("int").alias("n_quarantined"))


_SENT = r"[^.!?\n]+[.!?]*"


@register("sentence_split", f"""with t as (select doc_id, regexp_extract_all(text, '([\\s\\S]*?)({_SENT})', 1) as g,
  regexp_extract_all(text, '([\\s\\S]*?)({_SENT})', 2) as m from documents),
u as (select doc_id, unnest(g) as g, unnest(m) as m, unnest(range(1, len(m) + 1)) as i from t)
select doc_id, cast(i as int) as sent_no,
  cast(sum(length(g) + length(m)) over (partition by doc_id order by i) - length(m) as int) as start_pos,
  cast(sum(length(g) + length(m)) over (partition by doc_id order by i) as int) as end_pos from u""")
def sentence_split(spark, sf_dir):
    """Sentence spans of every whole text of the documents table."""
    return jobs.sentence_spans(inputs.base(spark, sf_dir, "documents").select("doc_id", "text"))


@register("gazetteer_mentions", """with w0 as (select doc_id, regexp_extract_all(text, '([\\s\\S]*?)(\\w+)', 1) as g,
  regexp_extract_all(text, '([\\s\\S]*?)(\\w+)', 2) as m from f_note),
w1 as (select doc_id, unnest(g) as g, unnest(m) as m, unnest(range(1, len(m) + 1)) as i from w0),
w as (select doc_id, i, m, cast(sum(length(g) + length(m)) over (partition by doc_id order by i) - length(m) as int) as s,
  cast(sum(length(g) + length(m)) over (partition by doc_id order by i) as int) as e from w1),
ng as (select doc_id, s as start_pos, e as end_pos, m as ngram from w
  union all select a.doc_id, a.s, b.e, a.m || ' ' || b.m from w a join w b on a.doc_id = b.doc_id and b.i = a.i + 1
  union all select a.doc_id, a.s, c.e, a.m || ' ' || b.m || ' ' || c.m from w a join w b on a.doc_id = b.doc_id and b.i = a.i + 1
    join w c on c.doc_id = a.doc_id and c.i = a.i + 2),
dic as (select array_to_string(string_split_regex(lower(trim(p_name)), '\\s+'), ' ') as key, min(""" + cui_sql("p_partkey") + """) as cui,
  cast(count(distinct p_partkey) as int) as n_cuis from part group by 1)
select ng.doc_id, ng.start_pos, ng.end_pos, ng.ngram as str, dic.cui, dic.n_cuis from ng join dic on lower(ng.ngram) = dic.key""")
def gazetteer_mentions(spark, sf_dir):
    """Part names as a label dictionary matched against the F4 notes."""
    labels = inputs.base(spark, sf_dir, "part").select(
        F.expr(cui_sql("p_partkey")).alias("cui"), F.col("p_name").alias("label"))
    m = jobs.gazetteer(inputs.view(spark, sf_dir, "f_note").select("doc_id", "text"), labels)
    return m.select("doc_id", "start_pos", "end_pos", "str", F.col("cuis")[0].alias("cui"), F.size("cuis").alias("n_cuis"))


@register("gazetteer_passages", r"""with w0 as (select doc_id, regexp_extract_all(text, '([\s\S]*?)(\w+)', 1) as g, regexp_extract_all(text, '([\s\S]*?)(\w+)', 2) as m from documents),
w1 as (select doc_id, unnest(g) as g, unnest(m) as m, unnest(range(1, len(m) + 1)) as i from w0),
w as (select doc_id, i, m, lead(m) over (partition by doc_id order by i) as next, cast(sum(length(g) + length(m)) over (partition by doc_id order by i) - length(m) as int) as s,
  cast(sum(length(g) + length(m)) over (partition by doc_id order by i) as int) as e from w1),
b as (select item_id, regexp_extract_all(lower(text), '\w+') as l from benchmark),
dic as (select array_to_string(l, ' ') as key, l[1] as first, l[2] as second, len(l) as n, cast(min(item_id) as varchar) as cui, cast(count(*) as int) as n_cuis from b where len(l) > 1 group by all),
c as (select doc_id, i, s, key, n, cui, n_cuis from w join dic on lower(m) = first and lower(next) = second),
r as (select c.doc_id, c.s as start_pos, max(x.e) as end_pos, string_agg(x.m, ' ' order by x.i) as str, key, cui, n_cuis
  from c join w x on x.doc_id = c.doc_id and x.i between c.i and c.i + n - 1 group by c.doc_id, c.i, c.s, key, cui, n_cuis)
select doc_id, start_pos, end_pos, str, cui, n_cuis from r where lower(str) = key""")
def gazetteer_passages(spark, sf_dir):
    """J5 with labels of many words: whole benchmark items as labels against every whole text of documents."""
    items = inputs.base(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("cui"), F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"(\w+)"), 1), " ").alias("label"))
    m = jobs.gazetteer(inputs.base(spark, sf_dir, "documents").select("doc_id", "text"), items)
    return m.select("doc_id", "start_pos", "end_pos", "str", F.col("cuis")[0].cast("string").alias("cui"), F.size("cuis").alias("n_cuis"))


_STATUS = JobStatus("success", datetime(2000, 1, 1), datetime(2024, 1, 15))
_NOW = datetime(2024, 1, 22)


@register("incremental_window", """select event_id, event_type, cast(cast(ts as date) as varchar) as day from events
 where ts between timestamp '2024-01-15 00:00:00' and timestamp '2024-01-22 00:00:00'""")
def incremental_window(spark, sf_dir):
    """Events modified inside the next job window after a successful run."""
    start, end = next_window(_STATUS, _NOW)
    ev = inputs.base(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return window_filter(ev, "ts", start, end).select(
        "event_id", "event_type", F.col("ts").cast("date").cast("string").alias("day"))


@register("handoff_docs", """select doc_id from f_doc where doc_id in (select doc_id from f_ann where ruled_by = '')
 and contentdate >= '19980101'""")
def handoff_docs(spark, sf_dir):
    """Documents to hand to the NLP step: those of the given to-do list (here:
    documents dated from 1998 on) among all documents."""
    docs = inputs.documents(spark, sf_dir)
    anns = inputs.annotations(spark, sf_dir).where(F.size("ruled_by") == 0).select("doc_id")
    todo = docs.where(F.col("contentdate") >= "19980101").select("doc_id")
    return jobs.handoff_list(docs.join(anns, "doc_id", "left_semi"), todo)
