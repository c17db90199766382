"""Display-level derivations as table operators (V*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sweep import covered



def _has(rule: str) -> Column:
    return F.coalesce(F.array_contains("ruled_by", rule), F.lit(False))


def effective_flags(anns: DataFrame) -> DataFrame:
    """V1/V2: negation, other-experiencer, hypothetical and abbreviation flags from
    the fields and the rules that ruled the mention ('' when ruled_by is missing)."""
    missing = F.col("ruled_by").isNull()
    neg = (F.when(missing, "").when(_has("positive_filters.json"), "Affirmed")
           .when((F.col("negation") == "Negated") | _has("negation_filters.json"), "Negated").otherwise("Affirmed"))
    oth = F.when(missing, "").when((F.col("experiencer") != "Patient") | _has("other_experiencer_filters.json"),
                                   "Other").otherwise("")
    hyp = F.when(missing, "").when((F.col("temporality") == "hypothetical") | _has("hypothetical_filters.json"),
                                   "hypo").otherwise("")
    abbr = F.when(missing, "").when(_has("s_abbr.json"), "abbrev").otherwise("")
    return anns.select("*", neg.alias("eff_negation"), oth.alias("eff_experiencer"), hyp.alias("hypothetical"),
                       abbr.alias("abbrev"))


def unify(mentions: DataFrame, phenotypes: DataFrame | None = None) -> DataFrame:
    """V3: mentions and phenotypes in one view ``(doc_id, idx, s, e, t, label, ..., category)``.

    ``idx`` numbers mentions first, then phenotypes, as the display does.
    """
    m = mentions.select("doc_id", F.col("ann_no").alias("idx"), F.col("start_pos").alias("s"),
                        F.col("end_pos").alias("e"), F.col("sty").alias("t"), F.col("pref").alias("label"),
                        "negation", "experiencer", "temporality", "ruled_by", F.lit("umls").alias("category"))
    if phenotypes is None:
        return m
    off = mentions.groupBy("doc_id").agg(F.max("ann_no").alias("_off"))
    p = phenotypes.join(off, "doc_id", "left").select(
        "doc_id", (F.coalesce("_off", F.lit(0)) + F.col("ann_no")).alias("idx"), F.col("start_pos").alias("s"),
        F.col("end_pos").alias("e"), F.col("minor_type").alias("t"), F.col("str").alias("label"),
        "negation", "experiencer", "temporality", "ruled_by", F.lit("customised").alias("category"))
    return m.unionByName(p)


def overlap_removed(view: DataFrame) -> DataFrame:
    """V4: ids ``(doc_id, idx)`` removed by the overlap rule.

    Sorted by start (stable on idx), each anchor with the run of following
    annotations that start before it ends forms a group; every group keeps
    only its longest member (ties: the later one in sort order).
    """
    return covered(view)


def remove_overlaps(view: DataFrame) -> DataFrame:
    """V4: the view without the removed annotations."""
    return view.join(overlap_removed(view), ["doc_id", "idx"], "left_anti")


def snippet(view: DataFrame, texts: DataFrame, more: int = 20) -> DataFrame:
    """V5: text around the first annotation (after overlap removal), marked up."""
    flags = effective_flags(view.withColumnRenamed("s", "start_pos").withColumnRenamed("e", "end_pos")) \
        .withColumnRenamed("start_pos", "s").withColumnRenamed("end_pos", "e")
    first = (remove_overlaps(flags).groupBy("doc_id")
             .agg(F.min(F.struct("s", "idx", "e", "t", "label", "category", "eff_negation", "temporality",
                                 "hypothetical", "abbrev", "eff_experiencer", "experiencer")).alias("f")))
    d = texts.select("doc_id", "text").join(first, "doc_id", "left")
    t, f = F.col("text"), F.col("f")
    s, e = f["s"], f["e"]
    prev = F.when(s > more, s - more).otherwise(s)
    end = F.least(e + more, F.length(t))
    # a phenotype shows its own experiencer field, a mention the effective one
    experiencer = F.when(f["category"] == "umls", f["eff_experiencer"]).otherwise(f["experiencer"])
    cls = F.concat_ws(" ", F.lit("default"), f["category"], f["eff_negation"], f["temporality"], f["hypothetical"],
                      f["abbrev"], experiencer)

    def sub(a, b):
        return F.when(b > a, F.substring(t, a + 1, b - a)).otherwise(F.lit(""))
    marked = F.concat(
        F.when(prev > 0, F.lit("...")).otherwise(F.lit("")), sub(prev, s),
        F.lit("<mark class='"), cls, F.lit("'><span title='"), f["t"], F.lit("' class=\"ann\">"), f["label"],
        F.lit(" | "), f["t"], F.lit("</span>"), sub(s, e), F.lit("</mark>"), sub(e, end),
        F.when(end < F.length(t), F.lit("...")).otherwise(F.lit("")))
    plain = F.concat(F.substring(t, 1, more), F.lit("..."))
    return d.select("doc_id", F.when(f.isNull(), plain).otherwise(marked).alias("snippet"))
