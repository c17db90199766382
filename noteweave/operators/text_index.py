"""Q7 full text by a positional inverted index with English stems and stop words.

Annotations repeat few distinct labels very often.  The index has three
tables: labels (numbered by a hash of their text), postings ``(term, label,
pos)`` of the labels' stems, and the distinct ``(label, doc_id)`` pairs.
Queries meet the postings first -- as many rows as labels hold their words --
and the documents only through the labels found, so all free-text terms of a
batch cost one join each way and no scan of the annotations.

Only distinct words are stemmed, in Arrow batches.  Stop words are in neither
index nor query but keep their places, so a phrase may run over them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.english import STOP_WORDS, stem
from . import search as Q


@dataclass
class TextIndex:
    """``postings (term, label, pos)`` and ``places (label, doc_id)``; label is a 64-bit hash of the label's text."""
    postings: DataFrame
    places: DataFrame

    def write(self, path: str) -> TextIndex:
        """Stored by term and by label, so that a query reads the files of its terms only."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/postings")
        self.places.repartitionByRange("label", "doc_id").sortWithinPartitions("label").write.parquet(f"{path}/places")
        return read_index(self.postings.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/places"))


def _stemmed(words: DataFrame) -> DataFrame:
    """``(word, term)`` of distinct words that are no stop words."""
    from pyspark import cloudpickle

    from ..functions import english
    cloudpickle.register_pickle_by_value(english)

    @F.arrow_udf("string")
    def stems(col: pa.Array) -> pa.Array:
        return pa.array([stem(w) for w in col.to_pylist()], pa.string())

    some = words.select("word").distinct().where(~F.col("word").isin(*sorted(STOP_WORDS)))
    return some.withColumn("term", stems("word"))


def build_index(anns: DataFrame, col: str = "pref") -> TextIndex:
    """The index of the labels in ``col``; rows without a label or a document are in no place."""
    pairs = anns.select("doc_id", F.col(col).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).distinct()
    label = F.xxhash64("text")
    words = F.filter(F.split(F.lower("text"), Q._WORD_SPLIT), lambda w: w != "")
    rows = pairs.select("text").distinct().select(label.alias("label"), F.posexplode(words).alias("pos", "word"))
    postings = rows.join(_stemmed(rows), "word").select("term", "label", F.col("pos").cast("int").alias("pos"))
    return TextIndex(postings, pairs.select(label.alias("label"), "doc_id"))


def query_words(spark: SparkSession, queries: Sequence[tuple[int, int, str]]) -> DataFrame | None:
    """``(query_id, term_no, grp, lit, negated, n, term, shift)`` of web-search texts: one row a word that counts.

    A literal of stop words alone is left out; None if nothing is left.  As small as the queries.
    """
    rows = []
    for query_id, term_no, text in queries:
        for g, group in enumerate(Q.parse_websearch(text)):
            for k, (negated, words) in enumerate(group):
                own = [(i, stem(w)) for i, w in enumerate(words) if w not in STOP_WORDS]
                rows += [(query_id, term_no, g, k, negated, len(own), w, i) for i, w in own]
    return spark.createDataFrame(rows, "query_id long, term_no int, grp int, lit int, negated boolean, n int, term string, shift int") if rows else None


def text_hits(index: TextIndex, docs: DataFrame, queries: Sequence[tuple[int, int, str]]) -> DataFrame:
    """``(query_id, term_no, doc_id)`` of web-search texts ``(query_id, term_no, text)``.

    A literal's words stand one after another in one label; a group of alternatives holds if one is found or a
    negated one is not; all groups must hold.  A text without words that count finds nothing.
    """
    spark = docs.sparkSession
    words = query_words(spark, queries)
    key = ["query_id", "term_no"]
    if words is None:
        return docs.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("term_no"), "doc_id").where(F.lit(False))
    met = index.postings.join(F.broadcast(words), "term").groupBy(*key, "grp", "lit", "negated", "n", "label", (F.col("pos") - F.col("shift")).alias("at")).agg(F.countDistinct("shift").alias("k"))
    labels = met.where(F.col("k") == F.col("n")).select(*key, "grp", "lit", "negated", "label").distinct()
    hits = labels.join(index.places, "label").select(*key, "grp", "lit", "negated", "doc_id").distinct()

    groups = words.select(*key, "grp", "lit", "negated").distinct().groupBy(*key, "grp").agg(F.sum(F.col("negated").cast("int")).alias("n_negated"))
    per_group = hits.groupBy(*key, "grp", "doc_id").agg(F.max(~F.col("negated")).alias("found"), F.sum(F.col("negated").cast("int")).alias("barred"))
    per_group = per_group.join(F.broadcast(groups), [*key, "grp"])  # as many rows as the queries have groups
    holds = (F.col("n_negated") == 0) & F.col("found")
    broken = (F.col("n_negated") > 0) & ~F.col("found") & (F.col("barred") == F.col("n_negated"))
    per_doc = per_group.groupBy(*key, "doc_id").agg(F.sum(holds.cast("int")).alias("held"), F.sum(broken.cast("int")).alias("broken"))
    wanted = groups.groupBy(*key).agg(F.sum((F.col("n_negated") == 0).cast("int")).alias("n_wanted"))
    plain = per_doc.join(F.broadcast(wanted), key).where((F.col("n_wanted") > 0) & (F.col("held") == F.col("n_wanted")) & (F.col("broken") == 0))

    # terms of negated groups only hold for every document that breaks none
    only = []
    for q, t, text in queries:
        counted = [[negated for negated, ws in group if not STOP_WORDS.issuperset(ws)] for group in Q.parse_websearch(text)]
        counted = [any(g) for g in counted if g]
        if counted and all(counted):
            only.append((q, t))
    out = plain.select(*key, "doc_id")
    if only:
        each = F.explode(F.array(*(F.struct(F.lit(q).cast("long").alias("query_id"), F.lit(t).alias("term_no")) for q, t in only)))
        every = docs.select("doc_id").distinct().select("doc_id", each.alias("t")).select("t.query_id", "t.term_no", "doc_id")
        out = out.unionByName(every.join(per_doc.where("broken > 0").select(*key, "doc_id"), [*key, "doc_id"], "left_anti"))
    return out


def batch_docs(anns: DataFrame, docs: DataFrame, queries: Sequence[Q.SearchQuery], index: TextIndex | None = None, **resolve) -> DataFrame:
    """``(query_id, doc_id)`` of many queries in one plan, free text included (Q1-Q9).

    A term that resolves to no concept is free text: without qualifiers it is looked up in the index, with
    qualifiers one annotation must have it as its preferred label and meet them.
    """
    spark = docs.sparkSession
    terms = Q.terms_frame(spark, queries)
    resolved = Q.resolve_terms(terms, **resolve)
    hits = Q.term_docs(anns, terms, resolved)
    key = ["query_id", "term_no"]
    free = terms.select(*key).distinct().join(resolved.select(*key).distinct(), key, "left_anti")
    plain, qualified = [], []
    for qi, query in enumerate(queries):
        for ti, t in enumerate(query.terms):
            tokens = t.q if isinstance(t.q, list) else t.q.split(",")
            if resolve.get("used_cuis") is None and all(Q.re.match(Q.CUI_RE, x) for x in tokens):
                continue  # a concept always resolves
            any_ = t.sty is None and t.negation == "Any" and t.experiencer == "Any" and Q._as_list(t.temporality) in ([], ["Any"])
            (plain if any_ else qualified).append((qi, ti, t.q if isinstance(t.q, str) else ",".join(t.q)))
    text = text_hits(index or build_index(anns), docs, plain)
    if qualified:
        own = terms.dropDuplicates(key).join(F.broadcast(spark.createDataFrame([q[:2] for q in qualified], "query_id long, term_no int")), key, "left_semi")
        met = anns.alias("a").join(F.broadcast(own).alias("t"), F.col("a.pref") == F.col("t.q")).where(Q._qualifier_match())
        text = text.unionByName(met.select("t.query_id", "t.term_no", "a.doc_id").distinct())
    hits = hits.unionByName(text.join(F.broadcast(free), key, "left_semi"))
    return Q.all_terms_docs(hits, terms)
