"""Cohort aggregation (A*): patient x concept roll-ups of mention tables.

All roll-ups are hash aggregations with a partial (map-side) step, so a hot
patient or CUI is pre-aggregated per task before the shuffle; the only
per-key sort is for the bounded top-k (``row_number() <= k``), which Spark
runs as a partial group limit before the shuffle as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positive_patient() -> Column:
    """A2: Affirmed and experienced by the patient."""
    return (F.col("negation") == "Affirmed") & (F.col("experiencer") == "Patient")


def not_ruled() -> Column:
    return F.coalesce(F.size("ruled_by"), F.lit(0)) == 0


def select_cohort_mentions(anns: DataFrame, sem_types: Sequence[str] | None) -> DataFrame:
    """A1: semantic type in list (``None`` -> nothing), positive and not ruled."""
    if sem_types is None:
        return anns.where(F.lit(False))
    return anns.where(F.col("sty").isin(list(sem_types)) & positive_patient() & not_ruled())


def doc_id_from_path(path_col: Column, pattern: str) -> Column:
    """A3: doc id from a file name by regex group 1 (case-insensitive); '' -> null."""
    v = F.regexp_extract(path_col, f"(?i){pattern}", 1)
    return F.when(v == "", None).otherwise(v)


def map_to_patients(mentions: DataFrame, doc2patient: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: attach ``patient_id``; also return docs without a patient (the report)."""
    d2p = doc2patient.select("doc_id", "patient_id")
    matched = mentions.join(d2p, "doc_id", "inner")
    unmatched = mentions.select("doc_id").distinct().join(d2p, "doc_id", "left_anti")
    return matched, unmatched


def patient_concept_counts(mentions: DataFrame, key: str = "cui") -> DataFrame:
    """A5: number of mentions per (patient, key)."""
    return mentions.groupBy("patient_id", key).agg(F.count(F.lit(1)).alias("n"))


def concept_labels(mentions: DataFrame) -> DataFrame:
    """First ``pref`` seen per CUI, first = lowest (doc_id, ann_no)."""
    return (mentions.groupBy("cui")
            .agg(F.min(F.struct("doc_id", "ann_no", "pref")).alias("_m"))
            .select("cui", F.col("_m.pref").alias("label")))


def patient_concept_graph(mentions: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """A5+A6+A7: ``(patient_id, cui, label, n, *extra_keys)`` sorted by lower(label).

    One partial aggregate per (patient, cui) carries the count and the
    earliest mention; the per-CUI label is taken from that much smaller
    table, so the mention table is scanned and shuffled once.
    """
    per = (mentions.groupBy("patient_id", "cui", *extra_keys)
           .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "ann_no", "pref")).alias("_first")))
    labels = per.groupBy("cui").agg(F.min("_first").alias("_l")).select("cui", F.col("_l.pref").alias("label"))
    return (per.join(labels, "cui")
            .select("patient_id", "cui", "label", "n", *extra_keys)
            .orderBy(F.lower("label"), "patient_id", "cui"))


def patient_concept_wide(mentions: DataFrame, concept_names: Sequence[str],
                         concept_col: str = "concept") -> DataFrame:
    """One row per patient, one count column per study concept, 0 if none.

    The concept list is given, so ``pivot`` needs no extra distinct-values job.
    """
    wide = (mentions.groupBy("patient_id").pivot(concept_col, list(concept_names))
            .agg(F.count(F.lit(1))))
    return wide.fillna(0, subset=list(concept_names))


def grouped_wide(mentions: DataFrame, concept_names: Sequence[str], group_col: str,
                 concept_col: str = "concept") -> DataFrame:
    """As A8, keyed by (group, patient); write with ``partitionBy(group_col)``."""
    wide = (mentions.groupBy(group_col, "patient_id").pivot(concept_col, list(concept_names))
            .agg(F.count(F.lit(1))))
    return wide.fillna(0, subset=list(concept_names))


def concept_samples(mentions: DataFrame, sample_size: int = 20,
                    concept_col: str = "concept") -> DataFrame:
    """A10: per concept, up to ``sample_size`` positive patients with their first doc.

    Patients are taken in patient-id order; the first doc is the lowest doc id.
    """
    first = (mentions.groupBy(concept_col, "patient_id")
             .agg(F.min("doc_id").alias("doc_id")))
    w = Window.partitionBy(concept_col).orderBy("patient_id")
    return (first.withColumn("sample_no", F.row_number().over(w))
            .where(F.col("sample_no") <= sample_size))


def sty_counts(anns: DataFrame) -> DataFrame:
    """Annotations per (doc, semantic type) with per-doc and grand totals (rollup)."""
    return anns.rollup("doc_id", "sty").agg(F.count(F.lit(1)).alias("n"))
