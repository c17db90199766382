"""Test views over the driver tables (FIXTURES.md part B).

The driver tables hold no clinical data, so every registered query first
derives rows of the schema an operator expects.  Each view is one SQL text
that runs unchanged in Spark SQL and in DuckDB; ``{t:lineitem}`` marks a base
table, rendered as a parquet path for Spark and as the view name for DuckDB.
These views only shape input; all operator work happens in ``operators/``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()

VIEWS: dict[str, str] = {}

# F1 annotations (one mention per line item) and their documents
VIEWS["f_ann"] = """
select l_orderkey as doc_id,
 cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate) as int) as ann_no,
 {cui:l_partkey} as cui, p_name as str, upper(p_name) as pref, p_type as sty,
 case when l_returnflag='R' then 'Negated' else 'Affirmed' end as negation,
 case when l_linestatus='F' and l_linenumber>=6 then 'Other' else 'Patient' end as experiencer,
 case when l_linenumber % 5=0 then 'historical' when l_linenumber % 7=0 then 'hypothetical' else 'Recent' end as temporality,
 cast(l_linenumber*12 as int) as start_pos, cast(l_linenumber*12+length(p_name) as int) as end_pos,
 case when l_discount>=0.09 then 'not_mention_filters.json' when l_tax>=0.07 then 'negation_filters.json' else '' end as ruled_by
 from {t:lineitem} join {t:part} on l_partkey=p_partkey
"""

VIEWS["f_doc"] = """
select o_orderkey as doc_id, '1.2.3.' || cast(o_orderkey as varchar(20)) as sopinstanceuid,
 '1.2.4.' || cast(o_custkey as varchar(20)) || '.' || substr(o_orderpriority,1,1) as seriesinstanceuid,
 '1.2.5.' || cast(o_custkey as varchar(20)) as studyinstanceuid, o_custkey as patient_id,
 replace(cast(cast(o_orderdate as date) as varchar(10)),'-','') as contentdate,
 case substr(o_orderpriority,1,1) when '1' then 'CT' when '2' then 'MR' when '3' then 'CT|SR' when '4' then 'MR|US' else 'XA' end as modalities
 from {t:orders}
"""

# Study concepts for K*: three overlapping CUI sets, in study order.
VIEWS["f_study"] = """
select 1 as ord, 'even_key' as name, {cui:p_partkey} as cui from {t:part} where p_partkey % 2 = 0
union all select 2, 'key_div3', {cui:p_partkey} from {t:part} where p_partkey % 3 = 0
union all select 3, 'low_key', {cui:p_partkey} from {t:part} where p_partkey < 50
"""

# Mapping file rows (S15): term -> entry, entry = CUI or CUI<tab>PREF<tab>STY;
# a second term for every tenth part makes duplicate CUIs (later line wins).
VIEWS["f_mapping"] = """
select 'brands' as map_name, cast(p_partkey as bigint) as line_no, p_brand as term,
 case when p_partkey % 3 = 0 then {cui:p_partkey} || chr(9) || upper(p_name) || chr(9) || p_type
      else {cui:p_partkey} end as entry
 from {t:part}
union all select 'brands', 1000000000000 + p_partkey, 'size ' || cast(p_size as varchar(10)), {cui:p_partkey}
 from {t:part} where p_partkey % 10 = 0
"""

# F6 reviewed rows (A12 shape); row_no keeps file order
VIEWS["f_reviewed"] = """
select l_orderkey as doc_id,
 l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate) as row_no,
 cast(l_linenumber*12 as int) as start_pos, cast(l_linenumber*12+length(p_name) as int) as end_pos,
 p_name as string_orig, {cui:l_partkey} as cui, p_type as label,
 case when l_discount < 0.05 then 'Yes' else 'No' end as correct,
 case when l_returnflag = 'R' then 'Negated' else 'NOT Negated' end as negation,
 case when l_orderkey % 8 = 0 then 'Yes' else 'No' end as skip_document
 from {t:lineitem} join {t:part} on l_partkey = p_partkey
"""

# Orders dealt over all parts (part keys run from 0)
VIEWS["f_order"] = """
select *, o_orderkey % (select max(p_partkey) + 1 from {t:part}) as part_no from {t:orders}
"""

# F2 tagged reports with injected identifiers
VIEWS["f_report"] = """
select o_orderkey as doc_id,
 'preamble dropped' || chr(10) || '[[Patient ID]]' || lpad(cast(o_custkey as varchar(20)),8,'0') || chr(10) || '[[Patient Name]] ' || replace(c_name,'#',' ') || 'son' || chr(10)
 || case when o_orderkey % 9=0 then '[[Comment]]' else '[[ContentSequence]]' end || chr(10)
 || 'CHI NUMBER: ' || lpad(cast(o_orderkey as varchar(20)),10,'1') || '. Seen by Dr. Jane Smith' || cast(o_custkey % 7 as varchar(20)) || ' on ' || substr(cast(cast(o_orderdate as date) as varchar(10)),9,2) || '/' || substr(cast(cast(o_orderdate as date) as varchar(10)),6,2) || '/' || substr(cast(cast(o_orderdate as date) as varchar(10)),1,4) || '.' || chr(10)
 || 'Tel: 0131 ' || lpad(cast(o_custkey as varchar(20)),3,'5') || ' ' || lpad(cast(o_orderkey as varchar(20)),4,'2') || ' or 07' || lpad(cast(o_orderkey as varchar(20)),9,'4') || chr(10)
 || 'Mail a' || cast(o_orderkey as varchar(20)) || '@clinic.example.org. The 69M patient, 46 yo, GMC: ' || lpad(cast(o_custkey as varchar(20)),7,'3') || ' , flat at IV2 3UJ' || chr(10)
 || 'No evidence of ' || p_name || '. Mother has ' || p_name || '. Query ' || p_name || '? Referred by  Dell, Michael (Cons)' || chr(10)
 || replace(c_name,'#',' ') || 'son was reviewed at Raigmore Hospital, Inverness.' || chr(10) as text
 from f_order join {t:customer} on o_custkey=c_custkey join {t:part} on p_partkey = part_no
"""

# F3 ontology sources (MRREL, MRCONSO, MRSTY stand-ins)
VIEWS["f_edge"] = """
select {cui:cast(floor((p_partkey-1)/3) as int)} as cui1, case when p_partkey % 4=0 then 'CHD' else 'RN' end as rel,
 {cui:p_partkey} as cui2, case when p_partkey % 5=0 then 'MSH' when p_partkey % 2=0 then 'MTH' else 'SNOMEDCT_US' end as sab from {t:part} where p_partkey>0
 union all select {cui:p_partkey},'RN',{cui:cast(floor(p_partkey/50) as int)},'MTH' from {t:part} where p_partkey % 10=0
 union all select {cui:cast(floor((p_partkey-1)/3) as int)},'PAR',{cui:p_partkey},'MTH' from {t:part} where p_partkey % 11=0 and p_partkey>0
"""

VIEWS["f_conso"] = """
select p_partkey*3+k as line_no, {cui:p_partkey} as cui,
 case when (p_partkey+k) % 7=0 then 'FRE' else 'ENG' end as lat, case when k=0 then 'P' else 'S' end as ts, case when k<2 then 'PF' else 'VO' end as stt,
 case when (p_partkey+k) % 3=0 then 'N' else 'Y' end as ispref, case when k=1 then 'SNOMEDCT_US' when k=2 then 'MTH' else 'NCI' end as sab,
 cast(10000000 + (p_partkey*k) % 150 as varchar(20)) as code, p_name || ' ' || cast(k as varchar(5)) as str
 from {t:part} cross join (values (0),(1),(2)) as v(k)
"""

VIEWS["f_sty"] = """
select p_partkey*2 as line_no, {cui:p_partkey} as cui, 'T' || lpad(cast(p_size as varchar(20)),3,'0') as tui from {t:part}
 union all select p_partkey*2+1, {cui:p_partkey}, 'T' || lpad(cast((p_size*7) % 50 + 1 as varchar(20)),3,'0') from {t:part} where p_partkey % 4=0
"""

# Semantic groups (SemGroups stand-in): group = first digit of the tui number.
VIEWS["f_semgroup"] = """
select distinct tui, 'G' || substr(cast(cast(substr(tui,2) as int) as varchar(10)),1,1) as tuigroup,
 'Group ' || substr(cast(cast(substr(tui,2) as int) as varchar(10)),1,1) as tuigrouplabel from f_sty
"""

# F4 notes with known context
VIEWS["f_tmpl"] = """
select * from (values
 (0,'Seen in room two.','The patient has ',' today.','Review soon.'),
 (1,'Seen in room two.','There was no evidence of ',' today.','Review soon.'),
 (2,'Seen in room two.','The patient has ',' but this was excluded.','Review soon.'),
 (3,'Her mother attended.','She has ',' today.','Review soon.'),
 (4,'Seen in room two.','We suspect ',' here.','Review soon.'),
 (5,'Seen in room two.','Gave a leaflet about ',' as asked.','Review soon.'),
 (6,'Seen in room two.','Known ',' clinic letter.','Review soon.'),
 (7,'Could there be a risk here?','The ',' was noted.','Review soon.'),
 (8,'GP Referral Form here.','The patient has ',' today.','Review soon.'),
 (9,'Seen. Memory Service Referral Form.','The patient has ',' today.','Review soon.'),
 (10,'Seen in room two.','The patient has ',' today?','It was ruled out.'),
 (11,'Seen in room two.','s wife has ',' today.','Review soon.')
) as t(tid,prev_s,before_s,after_s,next_s)
"""

VIEWS["f_note"] = """
select o_orderkey as doc_id, tid, prev_s || ' ' || before_s || mention || after_s || ' ' || next_s as text, mention,
 cast(0 as int) as s0, cast(length(prev_s) as int) as e0,
 cast(length(prev_s)+1 as int) as s1, cast(length(prev_s)+1+length(before_s)+length(mention)+length(after_s) as int) as e1,
 cast(length(prev_s)+2+length(before_s)+length(mention)+length(after_s) as int) as s2,
 cast(length(prev_s)+2+length(before_s)+length(mention)+length(after_s)+length(next_s) as int) as e2,
 cast(length(prev_s)+1+length(before_s) as int) as m_start, cast(length(prev_s)+1+length(before_s)+length(mention) as int) as m_end
 from f_order join f_tmpl on tid = o_orderkey % 12 join (select p_partkey, case when p_partkey % 13=0 then 'CVA' when p_partkey % 17=0 then 'ABC' else p_name end as mention from {t:part}) p on p_partkey = part_no
"""

# F4 in the annotation/sentence table shapes (M7, M9): three sentences and one
# mention per note; every sixth note has its mention offsets shifted by +2.
VIEWS["f_note_sent"] = """
select doc_id, 1 as sent_no, s0 as start_pos, e0 as end_pos from f_note
union all select doc_id, 2, s1, e1 from f_note
union all select doc_id, 3, s2, e2 from f_note
"""

VIEWS["f_note_ann"] = """
select doc_id, 1 as ann_no, mention as str, {cui:tid} as cui,
 case when doc_id % 6 = 0 then m_start + 2 else m_start end as start_pos,
 case when doc_id % 6 = 0 then m_end + 2 else m_end end as end_pos
 from f_note
"""

_REF = re.compile(r"\{t:(\w+)\}")
_CUI = re.compile(r"\{cui:([^}]+)\}")
_DEPS = re.compile(r"\b(f_\w+)\b")


def _deps(name: str, seen: list[str]) -> list[str]:
    for d in _DEPS.findall(VIEWS[name]):
        if d in VIEWS and d != name and d not in seen:
            _deps(d, seen)
    if name not in seen:
        seen.append(name)
    return seen


def cui_sql(key: str) -> str:
    """'C' and the key, in seven digits or as many as it has (both engines)."""
    k = f"cast({key} as varchar(20))"
    return f"('C' || case when length({k}) >= 7 then {k} else lpad({k}, 7, '0') end)"


def _render(sql: str, table_ref) -> str:
    return _REF.sub(lambda m: table_ref(m.group(1)), _CUI.sub(lambda m: cui_sql(m.group(1)), sql))


_NUMBER = re.compile(r"row_number\(\) over \([^()]*\)")


def _numbered_first(sql: str) -> str:
    """The same rows with the row number taken below the other columns.

    Spark makes the columns beside a window below the window's shuffle, which then holds table columns and what
    is made from them; this way it holds the table columns that are needed, once.
    """
    own = _NUMBER.search(sql)
    if own is None:
        return sql
    head, source = sql.replace(own.group(), "_no", 1).rsplit("\n from ", 1)
    return f"{head}\n from (select *, {own.group()} as _no from {source}) as numbered"


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build fixture view ``name`` over the parquet tables in ``sf_dir``."""
    order = _deps(name, [])
    ref = lambda t: f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`"
    ctes = [f"{v} as ({_render(_numbered_first(VIEWS[v]), ref)})" for v in order[:-1]]
    body = _render(_numbered_first(VIEWS[name]), ref)
    # no name around the view: columns with a qualifier hide from Spark that both sides of a union lie alike
    return spark.sql((f"with {', '.join(ctes)} " if ctes else "") + body)


def oracle_with(sql: str) -> str:
    """Prefix a DuckDB query with the fixture views it mentions, as CTEs."""
    order: list[str] = []
    for v in _DEPS.findall(sql):
        if v in VIEWS:
            _deps(v, order)
    if not order:
        return sql
    ref = lambda t: t
    ctes = ",\n".join(f"{v} as ({_render(VIEWS[v], ref)})" for v in order)
    head = sql.lstrip()
    low = head.lower()
    if low.startswith("with recursive "):
        return f"with recursive {ctes},\n{head[len('with recursive '):]}"
    if low.startswith("with "):
        return f"with {ctes},\n{head[len('with '):]}"
    return f"with {ctes}\n{sql}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
