"""Registered queries of the thirteen operators, with DuckDB SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import neighbours
from .bwt_dedup import repeat_digest
from .common import table
from .decontam import contamination, digest
from .filter_audit import audit
from .lm import lm_scores
from .mixing import TARGETS, by_language, mix
from .near_dup import near_duplicates
from .quality import quality
from .quality_rules import quality_rules
from .token_counts import token_counts
from .toxicity import toxicity
from .vector_codes import vector_codes
from .warc import page_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_round_trip(table(spark, sf_dir, "pages")).drop("problem")


ORACLES["op6_warc"] = """
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) x, max(page_id) over (partition by coalesce(html, '')) m from pages)
select page_id, cast(strlen(h) as bigint) as payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           cast(((('0x' || substr(x, cast((i // 4) * 5 + 1 as bigint), 5))::int >> (15 - 5 * (i % 4))::int) & 31) as bigint) + 1, 1)), 'string_agg', '') as payload_digest,
       case when page_id = m then 'response' else 'revisit' end as record_type,
       case when page_id = m then null else m end as refers_to
from p"""


@query
def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op9_minhash_near_dup"] = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') as l
  from documents),
s as (select doc_id, unnest(list_distinct(case when len(l) = 0 then []::varchar[] when len(l) < 5 then [array_to_string(l, ' ')]
                     else list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) end)) as sh from w),
h as (select distinct doc_id, md5_number(sh) as sh from s),
n as (select doc_id, count(*) as n from h group by 1),
-- equal sets form one class; links are sought between classes
k as (select doc_id, count(*) as n, sum(sh::double) as k1, min(sh) as k2, max(sh) as k3, bit_xor(sh) as k4 from h group by 1),
c as (select doc_id, min(doc_id) over (partition by n, k2, k3, k4) as rep from k),
r as (select h.* from h join c using (doc_id) where c.rep = c.doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as common from r x join r y on x.sh = y.sh and x.doc_id < y.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * common >= 85 * (x.n + y.n - common)),
g as (select a, b from e union select b, a from e),
reach as (select rep as a, rep as b from c union select reach.a, g.b from reach join g on reach.b = g.a),
m as (select a, min(b) as lowest from reach group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.lowest, d.doc_id) as component_id, d.doc_id = coalesce(m.lowest, d.doc_id) as kept
from documents d left join n using (doc_id) left join c using (doc_id) left join m on m.a = c.rep"""


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(contamination(docs, table(spark, sf_dir, "benchmark")))


ORACLES["op4_decontamination"] = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as l from documents),
b as (select cast(item_id as varchar) as item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as l from benchmark),
v as (select distinct item_id, least(len(l), 10) as size, unnest(list_transform(range(1, greatest(len(l) - 9, 1) + 1), lambda i: array_to_string(l[i:i + 9], ' '))) as win from b where len(l) > 0),
sizes as (select distinct size from v),
d as (select doc_id, size, unnest(range(1, len(l) - size + 2)) as p, unnest(list_transform(range(1, len(l) - size + 2), lambda i: array_to_string(l[i:i + size - 1], ' '))) as win
      from w, sizes where len(l) >= size),
m as (select d.doc_id, d.p, d.size, v.item_id from d join v using (size, win)),
h as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + size)) as q from m) group by 1),
i as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from m) group by 1)
select doc_id, cast(len(l) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from w left join h using (doc_id) left join i using (doc_id)"""


@query
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(table(spark, sf_dir, "documents"))


ORACLES["op3_suffix_array_dedup"] = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) as p from t),
w as (select doc_id, p, substr(h, 2 * p + 1, 100) as s from p),
m as (select s, min(doc_id) as lowest from w group by 1 having count(distinct doc_id) > 1),
c as (select doc_id, p, lag(p) over o as before, lead(p) over o as after from w join m using (s) where lowest < doc_id window o as (partition by doc_id order by p)),
r as (select doc_id, p, least(50, coalesce(after - p, 50)) as adds, sum(case when before is null or p > before + 50 then 1 else 0 end) over (partition by doc_id order by p) as span from c),
s as (select doc_id, span, min(p) as a, max(p) + 50 as z, sum(adds) as n from r group by 1, 2),
k as (select doc_id, a, z, n, coalesce(lag(z) over (partition by doc_id order by a), 0) as since from s),
g as (select k.doc_id, sum(n) as n_removed, count(*) as n_spans, max(z) as last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' order by a) as head from k join t using (doc_id) group by 1)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(case when n_removed is null then h else head || substr(h, 2 * last + 1) end)) as kept_sha256
from t left join g using (doc_id)"""


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mix(docs.select("doc_id", "text"), by_language(docs, table(spark, sf_dir, "labels")), TARGETS)
    return out.select("doc_id", "n_tokens", "domain", "posterior", "rate", "copies")


@query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[ \x09-\x0D]+'), lambda x: x <> '') as l from d),
m as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
             len(l) < 50 as a, 100 * len(list_distinct(l)) < 65 * len(l) as b,
             100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) as c,
             regexp_matches(t, '[#$%&*|]') as d, coalesce(w.doc_id > min(w.doc_id) over (partition by t), false) as e
      from w left join m on m.doc_id = w.doc_id),
n as (select part, list_value(a, b, c, d, e) as fails, good, toxic, count(*) as n from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 3, 4, 5]) as i),
o as (select p.x || q.x || r.x || s.x || t.x as filter_order, [p.i, q.i, r.i, s.i, t.i] as o from x p, x q, x r, x s, x t
      where len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
y as (select filter_order, o, unnest(range(1, 6)) as step from o),
-- position, in the order, of the first filter that removes the document
z as (select part, filter_order, step, n, good, toxic, fails[o[step]] as own, list_position(list_transform(o, lambda i: fails[i]), true) as first,
             len(list_filter(fails, lambda q: q)) as many, o[step] as filter from n, y),
g as (select part, filter_order, step, filter, cast(sum(case when first is null or first > step then n else 0 end) as bigint) as kept,
             cast(sum(case when first = step then n else 0 end) as bigint) as removed,
             cast(sum(case when own and first < step then n else 0 end) as bigint) as redundant,
             cast(sum(case when own and many = 1 then n else 0 end) as bigint) as unique_fails,
             cast(sum(case when first = step then n * good else 0 end) as bigint) as good_lost,
             cast(sum(case when first = step then n * toxic else 0 end) as bigint) as toxic_lost
      from z group by 1, 2, 3, 4)
select part, filter_order, cast(step as int) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       cast(sum(removed) over (partition by part, filter) as bigint) as shapley
from g"""


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _vector_codes_sql(rounds: int = 6) -> str:
    """The rounds spelt out: (part, entry, position) rows of each codebook, (row, part) rows of each assignment."""
    parts = ["""v as materialized (select row_number() over (order by vec_id, embedding) as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as x
      from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (select r, p, unnest(range(1, len(x) // 8 + 1)) as i, unnest(x[p * (len(x) // 8) + 1: (p + 1) * (len(x) // 8)]) as x
      from (select r, x, unnest(range(0, 8)) as p from v)),
b0 as materialized (select p, r - 1 as e, i, x as c from x where r <= 16)"""]
    for k in range(rounds + 1):
        parts.append(f"""d{k} as (select r, p, e, sum((x - c) * (x - c)) as d from x join b{k} using (p, i) group by all),
a{k} as materialized (select r, p, arg_min(e, (d, e)) as e, min(d) as d from d{k} group by all)""")
        if k < rounds:
            parts.append(f"""s{k} as (select p, e, i, sum(x) as s, count(*) as n from x join a{k} using (r, p) group by all),
b{k + 1} as materialized (select p, e, i, case when n is null then c when s >= 0 or s % n = 0 then s // n else s // n - 1 end as c from b{k} left join s{k} using (p, e, i))""")
    return "with " + ",\n".join(parts) + f"""
, o as (select r, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from a{rounds} group by 1)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(cast(c as varchar), ',' order by p, e, i)) from b{rounds}) as codebooks_sha256
from v join o using (r)"""


ORACLES["op13_vector_codes"] = _vector_codes_sql()


@query
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
