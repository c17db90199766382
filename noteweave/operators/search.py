"""Document search (Q*): concept terms with qualifiers, filters, projection.

Data model (normalised, no nested document blobs):

* ``docs(doc_id, sopinstanceuid, seriesinstanceuid, studyinstanceuid,
  patient_id, contentdate 'YYYYMMDD', modalities <sep>-separated)``
* ``anns(doc_id, ann_no, cui, str, pref, sty, negation, experiencer,
  temporality, ruled_by ARRAY<STRING>)``

A query is a driver-side object (a handful of terms).  Its terms become a
small DataFrame ``(query_id, term_no, token, qdepth, ..., negation,
experiencer, temporality, sty)`` so that one plan can answer many saved
queries at once; each term resolves to a CUI table, the mention table is
joined to it once (the term side is small and bounded by the query size
times the expansion, so Spark broadcasts it by its measured size), and the
document-level AND of terms is a relational division: a doc matches a query
when it matches every one of the query's terms.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ontology

SNOMED_RE = r"^\s*([0-9]{7,15})\s*$"
CUI_RE = r"^\s*([Cc][0-9]{5,15})\s*$"

# Fields a search may return (Q13); PatientID is deliberately absent.
RETURNABLE = {
    "SOPInstanceUID": "sopinstanceuid",
    "SeriesInstanceUID": "seriesinstanceuid",
    "StudyInstanceUID": "studyinstanceuid",
    "ContentDate": "contentdate",
    "ModalitiesInStudy": "modalities",
}


@dataclass
class Term:
    q: str | list[str]
    qdepth: int = 0
    qstop: Sequence[str] = ()
    qonlysty: bool = True
    negation: str = "Any"
    experiencer: str = "Any"
    temporality: str | list[str] = "Any"
    sty: str | None = None  # Q28a: semantic type on the same annotation


@dataclass
class Filter:
    start_date: str = ""
    end_date: str = ""
    modalities: str | list[str] = "Any"
    sopinstanceuid: Sequence[str] = ()
    seriesinstanceuid: Sequence[str] = ()
    studyinstanceuid: Sequence[str] = ()


@dataclass
class SearchQuery:
    terms: list[Term]
    filter: Filter = field(default_factory=Filter)
    return_fields: list[str] | str | None = None


# ---------------------------------------------------------------- Q1-Q5

_TERM_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("term_no", T.IntegerType()),
    T.StructField("token", T.StringType()), T.StructField("qdepth", T.IntegerType()),
    T.StructField("qonlysty", T.BooleanType()), T.StructField("qstop", T.ArrayType(T.StringType())),
    T.StructField("negation", T.StringType()), T.StructField("experiencer", T.StringType()),
    T.StructField("temporality", T.ArrayType(T.StringType())), T.StructField("sty", T.StringType()),
    T.StructField("q", T.StringType())])


def _as_list(v) -> list:
    if v is None:
        return []
    return list(v) if isinstance(v, (list, tuple)) else [v]


def terms_frame(spark: SparkSession, queries: Sequence[SearchQuery],
                first_query_id: int = 0) -> DataFrame:
    """Query objects -> one row per (query, term, token).  Bounded by query size."""
    rows = []
    for qi, sq in enumerate(queries):
        for ti, t in enumerate(sq.terms):
            tokens = t.q if isinstance(t.q, list) else t.q.split(",")
            temp = _as_list(t.temporality)
            temp = [] if temp in ([], ["Any"]) else temp  # X7: every value, not the first
            q = t.q if isinstance(t.q, str) else ",".join(t.q)
            for tok in tokens:
                rows.append((first_query_id + qi, ti, tok, int(t.qdepth), bool(t.qonlysty),
                             list(t.qstop), t.negation, t.experiencer, temp, t.sty, q))
    return spark.createDataFrame(rows, _TERM_SCHEMA)


def classify_tokens(terms: DataFrame, snomed: DataFrame | None,
                    mapping_names: DataFrame | None) -> DataFrame:
    """Q1/Q2: each token -> kind (cui | mapping | text) and seed CUI.

    SNOMED codes are looked up first (unknown code -> stays text, as X19: a
    code that maps to nothing is ignored).  Tokens are trimmed by the patterns.
    """
    t = terms.withColumn("_snomed", F.regexp_extract("token", SNOMED_RE, 1))
    if snomed is not None:
        s = snomed.select(F.col("snomed").alias("_snomed"), F.col("cui").alias("_snomed_cui"))
        t = t.join(s, "_snomed", "left")
    else:
        t = t.withColumn("_snomed_cui", F.lit(None).cast("string"))
    tok = F.when(F.col("_snomed_cui").isNotNull(), F.col("_snomed_cui")).otherwise(F.col("token"))
    t = t.withColumn("_tok", tok).withColumn("_cui", F.regexp_extract("_tok", CUI_RE, 1))
    if mapping_names is not None:
        mn = mapping_names.select(F.col("map_name").alias("_tok"), F.lit(True).alias("_is_map")).distinct()
        t = t.join(mn, "_tok", "left")
    else:
        t = t.withColumn("_is_map", F.lit(None).cast("boolean"))
    kind = (F.when(F.col("_cui") != "", "cui")
            .when(F.col("_is_map"), "mapping").otherwise("text"))
    return (t.withColumn("kind", kind)
            .withColumn("seed", F.when(F.col("_cui") != "", F.col("_cui"))
                        .when(F.col("_is_map"), F.col("_tok")))
            .drop("_snomed", "_snomed_cui", "_tok", "_cui", "_is_map"))


def resolve_terms(terms: DataFrame, *, snomed: DataFrame | None = None,
                  narrower: DataFrame | None = None, cui_groups: DataFrame | None = None,
                  mappings: DataFrame | None = None, used_cuis: DataFrame | None = None) -> DataFrame:
    """Q1-Q5: ``(query_id, term_no, ...)`` -> ``(query_id, term_no, cui)``.

    * CUI tokens expand by the narrower closure (U3) with the token's depth,
      stop list and same-type-group flag (default depth 0 = the CUI itself).
    * Mapping names give every CUI of the mapping (Q4).
    * Free-text tokens resolve to no CUI here (see ``text_term_docs``).
    * ``used_cuis`` keeps only CUIs that occur in the corpus (Q5).
    """
    names = mappings.select("map_name") if mappings is not None else None
    c = classify_tokens(terms, snomed, names)
    key = ["query_id", "term_no"]
    cui_tok = c.where(F.col("kind") == "cui")
    out = None
    if narrower is not None:
        roots = cui_tok.select(*key, F.col("seed").alias("root"), "qdepth", "qstop", "qonlysty")
        exp = ontology.closure_for_roots(roots, narrower, cui_groups, root_keys=key)
        out = exp.select(*key, "cui")
    else:
        out = cui_tok.select(*key, F.col("seed").alias("cui"))
    if mappings is not None:
        m = (c.where(F.col("kind") == "mapping").select(*key, F.col("seed").alias("map_name"))
             .join(mappings.select("map_name", "cui"), "map_name").select(*key, "cui"))
        out = out.unionByName(m)
    out = out.distinct()
    if used_cuis is not None:
        out = out.join(used_cuis.select("cui").distinct(), "cui", "left_semi")
    return out


def build_cui_index(anns: DataFrame) -> DataFrame:
    """Distinct (cui, doc_id); write it bucketed/sorted by cui for lookups."""
    return anns.select("cui", "doc_id").distinct()


# ---------------------------------------------------------------- Q6-Q9

def _qualifier_match(a: str = "a", t: str = "t") -> Column:
    ac, tc = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{t}.{c}"))
    neg = (tc("negation") == "Any") | (ac("negation") == tc("negation"))
    exp = (tc("experiencer") == "Any") | (ac("experiencer") == tc("experiencer"))
    tem = (F.size(tc("temporality")) == 0) | F.array_contains(tc("temporality"), ac("temporality"))
    sty = tc("sty").isNull() | (ac("sty") == tc("sty"))
    return neg & exp & tem & sty


def _term_qualifiers(t: Term) -> Column:
    """Qualifiers of one driver-side term as a predicate on an annotation row."""
    c = F.lit(True)
    if t.negation != "Any":
        c = c & (F.col("negation") == t.negation)
    if t.experiencer != "Any":
        c = c & (F.col("experiencer") == t.experiencer)
    temp = _as_list(t.temporality)
    if temp not in ([], ["Any"]):
        c = c & F.col("temporality").isin(temp)
    if t.sty is not None:
        c = c & (F.col("sty") == t.sty)
    return c


def term_docs(anns: DataFrame, terms: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(query_id, term_no, doc_id)`` for CUI and mapping terms.

    A document matches a term when ONE annotation carries one of the term's
    CUIs and satisfies all of the term's qualifiers (same-annotation
    semantics, applied to every expanded CUI and every temporality value).
    """
    quals = terms.select("query_id", "term_no", "negation", "experiencer", "temporality", "sty") \
        .dropDuplicates(["query_id", "term_no"])
    tq = resolved.join(quals, ["query_id", "term_no"])
    hit = anns.alias("a").join(tq.alias("t"), F.col("a.cui") == F.col("t.cui"))
    return (hit.where(_qualifier_match())
            .select(F.col("t.query_id").alias("query_id"), F.col("t.term_no").alias("term_no"),
                    F.col("a.doc_id").alias("doc_id")).distinct())


def all_terms_docs(term_hits: DataFrame, terms: DataFrame) -> DataFrame:
    """Q8: documents matching every term of their query (relational division)."""
    n_terms = terms.groupBy("query_id").agg(F.countDistinct("term_no").alias("_n"))
    per_doc = term_hits.groupBy("query_id", "doc_id").agg(F.countDistinct("term_no").alias("_k"))
    return per_doc.join(n_terms, "query_id").where(F.col("_k") == F.col("_n")).select("query_id", "doc_id")


# ---------------------------------------------------------------- Q7 full text

#: What parts words: anything but letters, marks and digits of any script.
_WORD_SPLIT = r"[^\p{L}\p{M}\p{N}]+"


def parse_websearch(q: str) -> list[list[tuple[bool, list[str]]]]:
    """Web-search syntax -> AND of OR-groups of (negated, phrase words).

    ``a b or c -d "e f"`` means a AND (b OR c) AND NOT d AND phrase "e f".
    Words are lower-cased and split like the document tokens (no stemming).
    """
    items = re.findall(r'(-?)"([^"]*)"|(\S+)', q)
    groups: list[list[tuple[bool, list[str]]]] = []
    pending_or = False
    for neg_q, phrase, word in items:
        if word and word.lower() == "or" and groups:
            pending_or = True
            continue
        if phrase or neg_q:
            neg, text = bool(neg_q), phrase
        else:
            neg, text = word.startswith("-") and len(word) > 1, word.lstrip("-") if word.startswith("-") else word
        words = "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in text.lower()).split()
        if not words:
            continue
        if pending_or:
            groups[-1].append((neg, words))
        else:
            groups.append([(neg, words)])
        pending_or = False
    return groups


def text_search(anns: DataFrame, docs: DataFrame, q: str, col: str = "pref") -> DataFrame:
    """Q7: doc ids whose ``col`` labels satisfy the web-search query ``q``.

    A word or phrase must occur as consecutive words of one label, so each
    label is tested by itself in one scan and a document keeps one flag per
    literal (a maximum, combined before the shuffle).  Words are runs of
    letters and digits of any script; a query without words finds nothing.
    """
    groups = parse_websearch(q)
    lits = sorted({" ".join(w) for g in groups for _, w in g})
    if not lits:
        return docs.select("doc_id").distinct().where(F.lit(False))
    # a label as its words between single blanks: each literal is one substring test, in one scan
    label = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.col(col)), _WORD_SPLIT, " ")), F.lit(" "))
    seen = (anns.select("doc_id", label.alias("_l"))
            .groupBy("doc_id").agg(*[F.max(F.contains("_l", F.lit(f" {lit} "))).alias(f"_h{i}") for i, lit in enumerate(lits)]))
    d = docs.select("doc_id").distinct().join(seen, "doc_id", "left")
    cond = F.lit(True)
    for g in groups:
        alt = F.lit(False)
        for neg, words in g:
            c = F.coalesce(F.col(f"_h{lits.index(' '.join(words))}"), F.lit(False))
            alt = alt | (~c if neg else c)
        cond = cond & alt
    return d.where(cond).select("doc_id")


# ---------------------------------------------------------------- Q10-Q16

def modality_filter(mods: str | Sequence[str], sep: str = "\\") -> Column | None:
    """Q10: any of the listed modalities; 'Any' (or a list of it) = no filter."""
    if mods in ("Any", ["Any"]) or mods is None:
        return None
    lst = mods.split(",") if isinstance(mods, str) else list(mods)
    parts = F.split(F.col("modalities"), re.escape(sep))
    return F.arrays_overlap(parts, F.array(*[F.lit(m) for m in lst]))


def date_filter(start: str, end: str, today: date | None = None) -> Column | None:
    """Q11: inclusive date range; missing end -> today, missing start -> 1990-01-01."""
    s, e = (start or "").replace("-", ""), (end or "").replace("-", "")
    if s and not e:
        e = (today or date.today()).strftime("%Y%m%d")
    if e and not s:
        s = "19900101"
    if not (s and e):
        return None
    d = F.try_to_date(F.col("contentdate"), "yyyyMMdd")
    return d.between(F.to_date(F.lit(s), "yyyyMMdd"), F.to_date(F.lit(e), "yyyyMMdd"))


def id_filters(flt: Filter) -> list[tuple[str, list[str]]]:
    """Q12: the SOP / Series / Study instance uid lists that are set."""
    return [(a, v) for a in ("sopinstanceuid", "seriesinstanceuid", "studyinstanceuid") if (v := list(getattr(flt, a) or []))]


def apply_filters(docs: DataFrame, flt: Filter, sep: str = "\\", today: date | None = None) -> DataFrame:
    for c in [modality_filter(flt.modalities, sep), date_filter(flt.start_date, flt.end_date, today)]:
        if c is not None:
            docs = docs.where(c)
    for attr, values in id_filters(flt):  # uploaded lists can be long: a semi-join, not a predicate
        ids = docs.sparkSession.createDataFrame([(v,) for v in values], f"{attr} string")
        docs = docs.join(ids, attr, "left_semi")
    return docs


def project(docs: DataFrame, return_fields: list[str] | str | None) -> DataFrame:
    """Q13/Q14: selected fields in order (default SOPInstanceUID), distinct."""
    if return_fields is None:
        return_fields = ["SOPInstanceUID"]
    if isinstance(return_fields, str):  # X11: a string is one field
        return_fields = [return_fields]
    cols = []
    for f in return_fields:
        if f not in RETURNABLE:
            raise ValueError(f"field {f!r} cannot be returned")
        cols.append(F.col(RETURNABLE[f]).alias(f))
    return docs.select(*cols).distinct()


def search(spark: SparkSession, docs: DataFrame, anns: DataFrame, query: SearchQuery, *,
           snomed: DataFrame | None = None, narrower: DataFrame | None = None,
           cui_groups: DataFrame | None = None, mappings: DataFrame | None = None,
           used_cuis: DataFrame | None = None, modality_sep: str = "\\",
           today: date | None = None, project_fields: bool = True) -> DataFrame:
    """Full search: resolve + expand terms, match, AND terms, filter, project."""
    if not query.terms:
        raise ValueError("a query needs at least one term")
    terms = terms_frame(spark, [query])
    resolved = resolve_terms(terms, snomed=snomed, narrower=narrower, cui_groups=cui_groups,
                             mappings=mappings, used_cuis=used_cuis)
    hits = term_docs(anns, terms, resolved)
    # free-text terms (no CUI resolved at all): full-text search on pref, or,
    # with qualifiers, pref equality on the same annotation.  The text path is
    # planned for every term and kept only for terms that resolved nothing
    # (left-anti join), so the plan never goes back to the driver.
    unresolved = terms.select("query_id", "term_no").distinct() \
        .join(resolved.select("query_id", "term_no").distinct(), ["query_id", "term_no"], "left_anti")
    for ti, t in enumerate(query.terms):
        q = t.q if isinstance(t.q, str) else ",".join(t.q)
        tokens = t.q if isinstance(t.q, list) else t.q.split(",")
        if used_cuis is None and all(re.match(CUI_RE, tok) for tok in tokens):
            continue  # a CUI always resolves (its closure holds itself): no text path
        qual = t.sty is not None or t.negation != "Any" or t.experiencer != "Any" or _as_list(t.temporality) not in ([], ["Any"])
        if qual:
            txt = anns.where((F.col("pref") == q) & _term_qualifiers(t)).select("doc_id").distinct()
        else:
            txt = text_search(anns, docs, q)
        txt = txt.select(F.lit(0).cast("long").alias("query_id"), F.lit(ti).cast("int").alias("term_no"), "doc_id")
        hits = hits.unionByName(txt.join(unresolved, ["query_id", "term_no"], "left_semi"))
    matched = all_terms_docs(hits, terms)
    d = docs.join(matched.select("doc_id"), "doc_id", "left_semi")
    d = apply_filters(d, query.filter, modality_sep, today)
    return project(d, query.return_fields) if project_fields else d


def fetch_by_key(docs: DataFrame, key: dict) -> DataFrame:
    """Q15: equality on every given field; ``{}`` -> no rows."""
    if not key:
        return docs.where(F.lit(False))
    cond = F.lit(True)
    for k, v in key.items():
        cond = cond & (F.col(RETURNABLE.get(k, k)) == F.lit(v))
    return docs.where(cond)


def paginate(df: DataFrame, order_by: Sequence[str], skip: int, limit: int) -> DataFrame:
    """Q16: page of a result in a stable order (sort, offset, limit)."""
    return df.orderBy(*order_by).offset(skip).limit(limit)


# ---------------------------------------------------------------- Q18-Q27

def ann_regex_docs(anns: DataFrame, pattern: str) -> DataFrame:
    """Q18: docs with an annotation whose pref or str matches (case-insensitive)."""
    p = f"(?iu){pattern}"
    return anns.where(F.col("pref").rlike(p) | F.col("str").rlike(p)).select("doc_id").distinct()


def doc_regex(texts: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """Q19: documents whose full text matches (case-insensitive search)."""
    return texts.where(F.col(text_col).rlike(f"(?iu){pattern}"))


def ann_text_regex_docs(anns: DataFrame, pattern: str, phenotypes: DataFrame | None = None) -> DataFrame:
    """Q20: regex over ``str | pref | cui | sty`` (case-insensitive), else over
    any phenotype's ``str | minor_type`` (case-sensitive, X15)."""
    joined = F.concat_ws(" | ", F.col("str").cast("string"), F.col("pref").cast("string"), "cui", "sty")
    hit = anns.where(joined.rlike(f"(?iu){pattern}")).select("doc_id")
    if phenotypes is not None:
        pj = F.concat_ws(" | ", F.col("str").cast("string"), "minor_type")
        hit = hit.unionByName(phenotypes.where(pj.rlike(pattern)).select("doc_id"))
    return hit.distinct()


DEFAULT_EXCLUDED_RULES = ("not_mention_filters.json", "skip terms")


def default_filtering(anns: DataFrame, excluded: Sequence[str] = DEFAULT_EXCLUDED_RULES) -> DataFrame:
    """Q21: drop annotations ruled by a not-mention rule or a skip term."""
    bad = F.array(*[F.lit(x) for x in excluded])
    return anns.where(~F.coalesce(F.arrays_overlap("ruled_by", bad), F.lit(False)))


def doc_detail(docs: DataFrame, anns: DataFrame, key: dict, texts: DataFrame | None = None) -> DataFrame:
    """Q22: one document (by key) with its default-filtered annotations (and text)."""
    d = fetch_by_key(docs, key)
    out = d.join(default_filtering(anns), "doc_id")
    if texts is not None:
        out = out.join(texts, "doc_id", "left")
    return out


def mapping_table(mapping_rows: DataFrame) -> DataFrame:
    """Mapping file rows ``(map_name, line_no, term, entry)`` -> ``(map_name, cui, term)``.

    The CUI is the text before the first tab; on a duplicate CUI the later
    line wins (``max_by`` on the line number, a partial aggregate).
    """
    m = mapping_rows.withColumn("cui", F.split("entry", "\t")[0])
    return (m.groupBy("map_name", "cui")
            .agg(F.max_by("term", "line_no").alias("term")))


def anns_by_mapping(anns: DataFrame, mapping: DataFrame, map_name: str) -> DataFrame:
    """Q23: keep mapped CUIs only, adding ``mapped`` term and ``mapping_name``.

    A mapping that does not exist leaves all rows as they are (both columns null).
    """
    own = mapping.where(F.col("map_name") == map_name)
    m = own.select("cui", F.col("term").alias("mapped"), F.col("map_name").alias("mapping_name"))
    known = own.agg(F.count(F.lit(1))).scalar() > 0  # part of the plan: nothing runs here
    return anns.join(m, "cui", "left").where(F.col("mapping_name").isNotNull() | ~known)


def docs_with_mapped(doc_ids: DataFrame, anns: DataFrame, mapping: DataFrame, map_name: str) -> DataFrame:
    """Q25: restrict a result to documents holding an annotation of the mapping."""
    mapped = anns_by_mapping(anns, mapping, map_name).select("doc_id").distinct()
    return doc_ids.join(mapped, "doc_id", "left_semi")


def finest_ids(result_docs: DataFrame, transaction_id: str) -> DataFrame:
    """Rows ``(transaction_id, id)``; id = SOP, else Series, else Study uid."""
    idc = F.coalesce(*[F.col(c) for c in ("sopinstanceuid", "seriesinstanceuid", "studyinstanceuid")
                       if c in result_docs.columns])
    return result_docs.select(F.lit(transaction_id).alias("transaction_id"), idc.alias("id")).distinct()


def training_sample(saved: DataFrame, seed: int = 42, max_n: int = 200, frac: float = 0.1) -> DataFrame:
    """Q26: random subset of a saved transaction, at most ``max_n`` and ``frac`` of it.

    The order is a seeded hash of the id (stable across runs and retries).
    Nothing runs here: the size is a scalar subquery of the plan, and only the
    ``max_n`` first rows by the hash are numbered.
    """
    n = saved.agg(F.count(F.lit(1))).scalar()
    by = [F.xxhash64("id", F.lit(seed)), F.col("id")]
    top = saved.orderBy(*by).limit(max_n).withColumn("_rank", F.row_number().over(Window.orderBy(*by)))
    return top.where(F.col("_rank") <= F.floor(n * F.lit(frac))).drop("_rank")


def list_docs(anns: DataFrame) -> DataFrame:
    """Q27: all document ids."""
    return anns.select("doc_id").distinct()


def result_envelope(results: DataFrame, transaction_id: str) -> tuple[DataFrame, DataFrame]:
    """Q17: one header row ``(success, num_results, transactionId)`` and the result rows.

    Both are DataFrames (one field -> one column of values, several -> one row
    per result): nothing runs before one of them is read.
    """
    header = results.agg(F.count(F.lit(1)).alias("num_results"))
    return header.select(F.lit(True).alias("success"), "num_results", F.lit(transaction_id).alias("transactionId")), results
