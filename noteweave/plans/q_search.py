"""Registered queries: document search (Q*) over F1 plus mapping files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import ontology, search, text_index
from ..operators.search import Filter, SearchQuery, Term
from . import inputs
from .q_ontology import SOURCES, _cui_tab
from .registry import register

SEP = "|"  # modality separator of the fixture (the real one is a backslash)
TODAY = date(2026, 1, 1)  # fixed 'today' so an open date range is reproducible

T1 = [f"C{k:07d}" for k in range(1, 21)]
T2 = [f"C{k:07d}" for k in range(21, 41)]


def _sql_list(xs):
    return ", ".join(f"'{x}'" for x in xs)


def _run(spark, sf_dir, q: SearchQuery, **kw):
    return search.search(spark, inputs.documents(spark, sf_dir), inputs.annotations(spark, sf_dir), q,
                         modality_sep=SEP, today=TODAY, **kw)


@register("search_cui", f"""select distinct d.sopinstanceuid as SOPInstanceUID from f_doc d
where d.doc_id in (select doc_id from f_ann where cui in ({_sql_list(T1)}))""")
def search_cui(spark, sf_dir):
    """Q6: documents with any annotation of a comma list of CUIs."""
    return _run(spark, sf_dir, SearchQuery([Term(",".join(T1))]))


@register("search_multi_term", f"""select distinct d.sopinstanceuid as SOPInstanceUID from f_doc d
where d.doc_id in (select doc_id from f_ann where cui in ({_sql_list(T1)}))
  and d.doc_id in (select doc_id from f_ann where cui in ({_sql_list(T2)}))""")
def search_multi_term(spark, sf_dir):
    """Q8: two terms, AND at document level."""
    return _run(spark, sf_dir, SearchQuery([Term(T1), Term(T2)]))


@register("search_qualifier", f"""select distinct d.sopinstanceuid as SOPInstanceUID from f_doc d
where d.doc_id in (select doc_id from f_ann where cui in ({_sql_list(T1 + T2)})
  and negation = 'Affirmed' and experiencer = 'Patient' and temporality in ('Recent', 'historical'))""")
def search_qualifier(spark, sf_dir):
    """Q9: qualifiers hold on the same annotation as the CUI (every CUI, every temporality)."""
    t = Term(T1 + T2, negation="Affirmed", experiencer="Patient", temporality=["Recent", "historical"])
    return _run(spark, sf_dir, SearchQuery([t]))


@register("search_sty", f"""select distinct d.sopinstanceuid as SOPInstanceUID from f_doc d
where d.doc_id in (select doc_id from f_ann where cui in ({_sql_list(T1 + T2)}) and sty = 'PROMO' and negation = 'Negated')""")
def search_sty(spark, sf_dir):
    """Semantic-type restriction on the same annotation."""
    return _run(spark, sf_dir, SearchQuery([Term(T1 + T2, sty="PROMO", negation="Negated")]))


@register("search_modality_date", f"""select distinct d.sopinstanceuid as SOPInstanceUID, d.contentdate as ContentDate,
 d.modalities as ModalitiesInStudy from f_doc d
where d.doc_id in (select doc_id from f_ann where cui in ({_sql_list(T1 + T2)}))
  and list_has_any(string_split(d.modalities, '|'), ['CT', 'SR'])
  and strptime(d.contentdate, '%Y%m%d')::date between date '1996-01-01' and date '1997-12-31'""")
def search_modality_date(spark, sf_dir):
    """Q10/Q11: modality list and inclusive date range."""
    q = SearchQuery([Term(T1 + T2)], Filter(start_date="1996-01-01", end_date="19971231", modalities="CT,SR"),
                    ["SOPInstanceUID", "ContentDate", "ModalitiesInStudy"])
    return _run(spark, sf_dir, q)


@register("search_open_date", f"""select distinct d.sopinstanceuid as SOPInstanceUID from f_doc d
where d.doc_id in (select doc_id from f_ann where cui in ({_sql_list(T1)}))
  and strptime(d.contentdate, '%Y%m%d')::date between date '1999-06-01' and date '2026-01-01'""")
def search_open_date(spark, sf_dir):
    """Q11: start date only -> the range ends today (fixed here for reproducibility)."""
    return _run(spark, sf_dir, SearchQuery([Term(T1)], Filter(start_date="1999-06-01")))


_STUDIES = [f"1.2.5.{k}" for k in range(1, 400, 3)]


@register("search_uid_list", f"""select distinct d.seriesinstanceuid as SeriesInstanceUID from f_doc d
where d.doc_id in (select doc_id from f_ann where cui in ({_sql_list(T1 + T2)}))
  and d.studyinstanceuid in ({_sql_list(_STUDIES)})""")
def search_uid_list(spark, sf_dir):
    """Q12: study instance uid list filter, returning series ids."""
    q = SearchQuery([Term(T1 + T2)], Filter(studyinstanceuid=_STUDIES), "SeriesInstanceUID")
    return _run(spark, sf_dir, q)


@register("search_page", f"""select SOPInstanceUID from (select distinct d.sopinstanceuid as SOPInstanceUID from f_doc d
where d.doc_id in (select doc_id from f_ann where cui in ({_sql_list(T1 + T2)})))
order by SOPInstanceUID limit 25 offset 10""")
def search_page(spark, sf_dir):
    """Q16: second page (skip 10, limit 25) in id order."""
    r = _run(spark, sf_dir, SearchQuery([Term(T1 + T2)]))
    return search.paginate(r, ["SOPInstanceUID"], 10, 25)


@register("search_return_fields", f"""select distinct d.studyinstanceuid as StudyInstanceUID, d.contentdate as ContentDate from f_doc d
where d.doc_id in (select doc_id from f_ann where cui in ({_sql_list(T1)}))""")
def search_return_fields(spark, sf_dir):
    """Q13/Q14: projection in order, distinct."""
    return _run(spark, sf_dir, SearchQuery([Term(T1)], return_fields=["StudyInstanceUID", "ContentDate"]))


@register("doc_by_key", """select * from f_doc where sopinstanceuid = '1.2.3.7'""")
def doc_by_key(spark, sf_dir):
    """Q15: fetch a document by a field value."""
    return search.fetch_by_key(inputs.documents(spark, sf_dir), {"SOPInstanceUID": "1.2.3.7"})


@register("default_filtered", """select doc_id, ann_no, cui, ruled_by from f_ann
where ruled_by not in ('not_mention_filters.json', 'skip terms')""")
def default_filtered(spark, sf_dir):
    """Q21: annotations not ruled by a not-mention rule or a skip term."""
    f = search.default_filtering(inputs.annotations(spark, sf_dir))
    return f.select("doc_id", "ann_no", "cui", inputs.joined("ruled_by", ","))


@register("doc_detail", """select d.doc_id, d.sopinstanceuid, a.ann_no, a.cui, a.pref from f_doc d join f_ann a on d.doc_id = a.doc_id
where d.sopinstanceuid = '1.2.3.7' and a.ruled_by not in ('not_mention_filters.json', 'skip terms')""")
def doc_detail(spark, sf_dir):
    """Q22: one document with its default-filtered annotations."""
    d = search.doc_detail(inputs.documents(spark, sf_dir), inputs.annotations(spark, sf_dir),
                          {"SOPInstanceUID": "1.2.3.7"})
    return d.select("doc_id", "sopinstanceuid", "ann_no", "cui", "pref")


_MAP_SQL = """mp as (select map_name, cui, arg_max(term, line_no) as term from
  (select map_name, line_no, term, split_part(entry, chr(9), 1) as cui from f_mapping) group by map_name, cui)"""


def _mapping(spark, sf_dir):
    return search.mapping_table(inputs.view(spark, sf_dir, "f_mapping"))


@register("mapping_table", f"with {_MAP_SQL} select map_name, cui, term from mp")
def mapping_table(spark, sf_dir):
    """Mapping rows inverted to CUI -> term (text before the first tab; later line wins)."""
    return _mapping(spark, sf_dir)


@register("by_mapping", f"""with {_MAP_SQL}
select a.doc_id, a.ann_no, a.cui, mp.term as mapped, mp.map_name as mapping_name from f_ann a join mp on a.cui = mp.cui
where mp.map_name = 'brands'""")
def by_mapping(spark, sf_dir):
    """Q23: annotations through a mapping, with mapped term and mapping name."""
    m = search.anns_by_mapping(inputs.annotations(spark, sf_dir), _mapping(spark, sf_dir), "brands")
    return m.select("doc_id", "ann_no", "cui", "mapped", "mapping_name")


@register("search_by_mapping", f"""with {_MAP_SQL}
select distinct d.sopinstanceuid as SOPInstanceUID from f_doc d
where d.doc_id in (select doc_id from f_ann where cui in ({_sql_list(T1)}))
  and d.doc_id in (select a.doc_id from f_ann a join mp on a.cui = mp.cui where mp.map_name = 'brands' and mp.term like 'size%')
  and list_has_any(string_split(d.modalities, '|'), ['MR'])""")
def search_by_mapping(spark, sf_dir):
    """Q25: search, then keep documents holding an annotation mapped to a 'size' term."""
    mp = _mapping(spark, sf_dir).where(F.col("term").startswith("size"))
    r = _run(spark, sf_dir, SearchQuery([Term(T1)], Filter(modalities=["MR"])), project_fields=False)
    r = search.docs_with_mapped(r, inputs.annotations(spark, sf_dir), mp, "brands")
    return search.project(r, None)


@register("search_mapping_term", f"""with {_MAP_SQL}
select distinct d.sopinstanceuid as SOPInstanceUID from f_doc d
where d.doc_id in (select a.doc_id from f_ann a join mp on a.cui = mp.cui where mp.map_name = 'brands')
  and d.modalities = 'XA'""")
def search_mapping_term(spark, sf_dir):
    """Q4: a mapping name as the query term expands to every CUI of the mapping."""
    q = SearchQuery([Term("brands")], Filter(modalities="XA"))
    return _run(spark, sf_dir, q, mappings=_mapping(spark, sf_dir))


@register("search_regex", """select distinct doc_id from f_ann where regexp_matches(pref, 'red (bolt|gear)', 'i') or regexp_matches(str, 'red (bolt|gear)', 'i')""")
def search_regex(spark, sf_dir):
    """Q18: annotation regex on pref or str, case-insensitive."""
    return search.ann_regex_docs(inputs.annotations(spark, sf_dir), "red (bolt|gear)")


@register("doc_regex", """select doc_id from documents where regexp_matches(text, '[a-z0-9._]+@[a-z0-9.-]+[.][a-z]{2,}', 'i')""")
def doc_regex(spark, sf_dir):
    """Q19: full-document regex search over the whole documents table."""
    d = search.doc_regex(inputs.base(spark, sf_dir, "documents").select("doc_id", "text"),
                         "[a-z0-9._]+@[a-z0-9.-]+[.][a-z]{2,}")
    return d.select("doc_id")


@register("search_ann_regex", """select distinct doc_id from f_ann
where regexp_matches(str || ' | ' || pref || ' | ' || cui || ' | ' || sty, 'C00000[1-3][0-9] [|] promo', 'i')""")
def search_ann_regex(spark, sf_dir):
    """Q20: regex over 'str | pref | cui | sty' (case-insensitive)."""
    return search.ann_text_regex_docs(inputs.annotations(spark, sf_dir), "C00000[1-3][0-9] [|] promo")


_TEXT_Q = '"red bolt" or "blue gear" -small hot'
_TOK_SQL = """tok as (select doc_id, ann_no, unnest(string_split_regex(lower(pref), '[^a-z0-9]+')) as word,
  unnest(range(1, len(string_split_regex(lower(pref), '[^a-z0-9]+')) + 1)) as pos from f_ann)"""


@register("search_text", f"""with {_TOK_SQL}
select d.doc_id from (select distinct doc_id from f_doc) d
where (exists (select 1 from tok a join tok b on a.doc_id = b.doc_id and a.ann_no = b.ann_no and b.pos = a.pos + 1
               where a.doc_id = d.doc_id and a.word = 'red' and b.word = 'bolt')
    or exists (select 1 from tok a join tok b on a.doc_id = b.doc_id and a.ann_no = b.ann_no and b.pos = a.pos + 1
               where a.doc_id = d.doc_id and a.word = 'blue' and b.word = 'gear'))
  and not exists (select 1 from tok where tok.doc_id = d.doc_id and word = 'small')
  and exists (select 1 from tok where tok.doc_id = d.doc_id and word = 'hot')""")
def search_text(spark, sf_dir):
    """Q7: web-search syntax over preferred labels (phrases, OR, negation, AND)."""
    return search.text_search(inputs.annotations(spark, sf_dir), inputs.documents(spark, sf_dir), _TEXT_Q)


@register("list_docs", "select distinct doc_id from f_ann")
def list_docs(spark, sf_dir):
    """Q27: all document ids."""
    return search.list_docs(inputs.annotations(spark, sf_dir))


# Q1-Q5: several saved queries resolved and answered in one plan.
BATCH = [
    SearchQuery([Term("10000007", qdepth=1, qonlysty=False)]),
    SearchQuery([Term("C0000003", qdepth=2, qonlysty=False), Term("C0000001,C0000002,C0000004", qdepth=0)]),
    SearchQuery([Term("C0000005,lung", qdepth=1, qonlysty=False)]),
    SearchQuery([Term(["C0000009", "10000020"], qdepth=0)]),
    SearchQuery([Term("C0000002", qdepth=3, qonlysty=True, negation="Affirmed")]),
    SearchQuery([Term("brands", negation="Negated", experiencer="Other")]),
]


def _batch_values_sql():
    rows = []
    for qi, sq in enumerate(BATCH):
        for ti, t in enumerate(sq.terms):
            toks = t.q if isinstance(t.q, list) else t.q.split(",")
            for tok in toks:
                rows.append(f"({qi}, {ti}, '{tok}', {t.qdepth}, {str(t.qonlysty).lower()}, '{t.negation}', '{t.experiencer}')")
    return ",\n ".join(rows)


_EDGES = f"""ed as (select distinct cui1, cui2 from f_edge
  where rel in ('RN','CHD') and sab in ({_sql_list(SOURCES)}) and cui1 <> cui2
  except select cui1, cui2 from f_edge where rel in ('RB','PAR') and sab in ({_sql_list(SOURCES)}))"""


@register("query_batch", f"""with recursive {_EDGES}, {_MAP_SQL},
cg as (select s.cui, g.tuigroup from f_sty s join f_semgroup g on s.tui = g.tui),
sn as (select code as snomed, arg_max(cui, line_no) as cui from f_conso where lat = 'ENG' and sab = 'SNOMEDCT_US' group by code),
tk(query_id, term_no, token, qdepth, qonlysty, negation, experiencer) as (values
 {_batch_values_sql()}),
t2 as (select tk.*, coalesce(sn.cui, tk.token) as tok from tk left join sn on sn.snomed = regexp_extract(tk.token, '^\\s*([0-9]{{7,15}})\\s*$', 1)),
t3 as (select *, regexp_extract(tok, '^\\s*([Cc][0-9]{{5,15}})\\s*$', 1) as seed from t2),
cl(query_id, term_no, root, qdepth, qonlysty, cui, depth) as (
  select query_id, term_no, seed, qdepth, qonlysty, seed, 0 from t3 where seed <> ''
  union select cl.query_id, cl.term_no, cl.root, cl.qdepth, cl.qonlysty, ed.cui2, cl.depth + 1 from cl join ed on cl.cui = ed.cui1
  where cl.depth < cl.qdepth and (not cl.qonlysty or exists (
    select 1 from cg a join cg b on a.tuigroup = b.tuigroup where a.cui = cl.root and b.cui = ed.cui2))),
res as (select distinct query_id, term_no, cui from cl
  union select t3.query_id, t3.term_no, mp.cui from t3 join mp on mp.map_name = t3.tok where t3.seed = ''),
qual as (select distinct query_id, term_no, negation, experiencer from tk),
hits as (select distinct r.query_id, r.term_no, a.doc_id from res r join qual q on r.query_id = q.query_id and r.term_no = q.term_no
  join f_ann a on a.cui = r.cui
  where (q.negation = 'Any' or a.negation = q.negation) and (q.experiencer = 'Any' or a.experiencer = q.experiencer)),
nt as (select query_id, count(distinct term_no) as n from tk group by query_id)
select h.query_id, h.doc_id from hits h join nt on h.query_id = nt.query_id
group by h.query_id, h.doc_id, nt.n having count(distinct h.term_no) = nt.n""")
def query_batch(spark, sf_dir):
    """Q1-Q5 + Q6/Q8/Q9: six saved queries (SNOMED, CUI with depth and type filter,
    comma lists with text, list form, mapping name) resolved and matched in one plan."""
    terms = search.terms_frame(spark, BATCH)
    conso = inputs.view(spark, sf_dir, "f_conso")
    edges = ontology.narrower_edges(inputs.view(spark, sf_dir, "f_edge"), SOURCES)
    resolved = search.resolve_terms(terms, snomed=ontology.snomed_to_cui_table(conso), narrower=edges,
                                    cui_groups=_cui_tab(spark, sf_dir), mappings=_mapping(spark, sf_dir))
    hits = search.term_docs(inputs.annotations(spark, sf_dir), terms, resolved)
    return search.all_terms_docs(hits, terms).select(F.col("query_id").cast("int").alias("query_id"), "doc_id")


@register("transaction_sample")
def transaction_sample(spark, sf_dir):
    """S19 + Q26: save a result under a transaction id (finest id kept), then draw a
    seeded random training sample of at most 200 and at most 10 %."""
    r = _run(spark, sf_dir, SearchQuery([Term(T1 + T2)]), project_fields=False)
    saved = search.finest_ids(r, "tx-0001")
    return search.training_sample(saved, seed=7)


# Free text with stems, stop words, phrases over stop words, negation and qualifiers, beside concepts and mappings.
TEXT_BATCH = [
    SearchQuery([Term("bolts")]),
    SearchQuery([Term('"the red of bolts"'), Term("C0000003", qdepth=2, qonlysty=False)]),
    SearchQuery([Term('plating or "hot gears"'), Term("-small -old")]),
    SearchQuery([Term("the of and")]),
    SearchQuery([Term("RED BOLT", negation="Negated")]),
    SearchQuery([Term("C0000005,lung", qdepth=1, qonlysty=False), Term("widgets -(cold)")]),
    SearchQuery([Term("-anvil")]),
]


def _phrase_sql(first, second, gap=1):
    return f"""select distinct a.doc_id from tok a join tok b on a.doc_id = b.doc_id and a.ann_no = b.ann_no and b.pos = a.pos + {gap}
  where a.word = '{first}' and b.word = '{second}'"""


def _word_sql(word):
    return f"select distinct doc_id from tok where word = '{word}'"


@register("query_batch_text", f"""with recursive {_EDGES}, {_MAP_SQL}, {_TOK_SQL},
cl(cui, depth) as (select 'C0000003', 0 union select ed.cui2, cl.depth + 1 from cl join ed on cl.cui = ed.cui1 where cl.depth < 2),
c5(cui, depth) as (select 'C0000005', 0 union select ed.cui2, c5.depth + 1 from c5 join ed on c5.cui = ed.cui1 where c5.depth < 1),
d as (select distinct doc_id from f_doc),
q1b as (select distinct doc_id from f_ann where cui in (select cui from cl)),
q5a as (select distinct doc_id from f_ann where cui in (select cui from c5) or cui in (select cui from mp where map_name = 'lung'))
select 0 as query_id, doc_id from ({_word_sql('bolt')})
union all select 1, doc_id from ({_phrase_sql('red', 'bolt', 2)}) where doc_id in (from q1b)
union all select 2, doc_id from ({_word_sql('plate')} union {_phrase_sql('hot', 'gear')})
  where doc_id not in ({_word_sql('small')}) and doc_id not in ({_word_sql('old')})
union all select distinct 4, doc_id from f_ann where pref = 'RED BOLT' and negation = 'Negated'
union all select 5, doc_id from q5a where doc_id in ({_word_sql('widget')}) and doc_id not in ({_word_sql('cold')})
union all select 6, doc_id from d where doc_id not in ({_word_sql('anvil')})""")
def query_batch_text(spark, sf_dir):
    """Q1-Q9 of seven saved queries in one plan, five of them with free text, by the positional index."""
    edges = ontology.narrower_edges(inputs.view(spark, sf_dir, "f_edge"), SOURCES)
    out = text_index.batch_docs(inputs.annotations(spark, sf_dir), inputs.documents(spark, sf_dir), TEXT_BATCH,
                                snomed=ontology.snomed_to_cui_table(inputs.view(spark, sf_dir, "f_conso")), narrower=edges,
                                cui_groups=_cui_tab(spark, sf_dir), mappings=_mapping(spark, sf_dir))
    return out.select(F.col("query_id").cast("int").alias("query_id"), "doc_id")


@register("text_postings", f"""with {_TOK_SQL.replace('doc_id, ann_no, unnest', 'pref, unnest').replace('from f_ann', "from (select distinct pref from f_ann)")}
select case word when 'large' then 'larg' else word end as term, count(distinct pref) as n_labels, min(pos) - 1 as first_pos from tok group by 1""")
def text_postings(spark, sf_dir):
    """Q7: the index's terms, with the labels that hold each and its least position."""
    p = text_index.build_index(inputs.annotations(spark, sf_dir)).postings
    return p.groupBy("term").agg(F.countDistinct("label").alias("n_labels"), F.min("pos").cast("long").alias("first_pos"))
