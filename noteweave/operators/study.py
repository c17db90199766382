"""Study concepts (K*): load, make disjoint, explain overlaps, tag mentions.

A study concept table has the shape ``(ord INT, name STRING, cui STRING)``:
one row per CUI of a concept's closure, ``ord`` is the concept's position in
the study.  It can hold millions of CUIs (closures of broad concepts), so every
step is a keyed aggregation with partial (map-side) combine, never a driver
dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import line_place

from ..functions.partitioning import dense_rank_within

_MANUAL_SCHEMA = T.MapType(T.StringType(), T.StructType([
    T.StructField("concepts", T.ArrayType(T.StringType())),
    T.StructField("tc", T.StructType([T.StructField("closure", T.IntegerType()),
                                       T.StructField("mapped", T.StringType())]))]))


def concepts_from_tsv(spark: SparkSession, path: str) -> DataFrame:
    """K1: ``label<TAB>cui`` lines; each line is its own concept with a 1-CUI closure.

    Lines without exactly two fields are returned with ``ok = false`` so the
    caller can report them.  ``ord`` is the line's place: files in order of their names, lines in order.
    """
    lines = spark.read.text(path).withColumn("_f", F.split("value", "\t"))
    return lines.select(
        line_place().alias("ord"),
        F.get("_f", 0).alias("name"), F.get("_f", 1).alias("cui"),  # get: null past the end (ANSI-safe)
        (F.size("_f") == 2).alias("ok"))


def concepts_from_manual_json(spark: SparkSession, path: str) -> DataFrame:
    """K2: ``{name: {concepts: [...], tc: {...}}}`` -> ``(ord, name, cui)``; ord = key order."""
    doc = spark.read.text(path, wholetext=True)
    m = F.from_json("value", _MANUAL_SCHEMA)
    return (doc.select(F.posexplode(m).alias("pos", "name", "v"))
            .select((F.col("pos") + 1).cast("int").alias("ord"), "name",
                    F.explode("v.concepts").alias("cui")))


def retain_concepts(concepts: DataFrame, names: DataFrame) -> DataFrame:
    """K5: keep only listed concept names (left-semi join on ``name``)."""
    return concepts.join(names.select("name").distinct(), "name", "left_semi")


def disjoint_concepts(concepts: DataFrame) -> DataFrame:
    """K7: each CUI stays only in the last concept (highest ``ord``) holding it.

    ``max(struct(ord, name))`` per CUI is a hash aggregate with a partial
    map-side step, so a CUI present in many rows never gathers in one task.
    """
    best = concepts.groupBy("cui").agg(F.max(F.struct("ord", "name")).alias("_o"))
    return best.select(F.col("_o.ord").alias("ord"), F.col("_o.name").alias("name"), "cui")


def overlap_sizes(concepts: DataFrame) -> DataFrame:
    """K8: how many CUIs concept i (later) takes away from concept j (earlier).

    The reference removes Ci∩Cj from Cj for i>j in order, so a CUI is counted
    for the pair (next owner after j, j): consecutive owners of each CUI.
    """
    owners = concepts.select("cui", "ord", "name").distinct()
    w = Window.partitionBy("cui").orderBy("ord")
    pairs = (owners.withColumn("_next_ord", F.lead("ord").over(w))
             .withColumn("_next_name", F.lead("name").over(w))
             .where(F.col("_next_ord").isNotNull()))
    return (pairs.groupBy(F.col("_next_ord").alias("ord_i"), F.col("_next_name").alias("concept_i"),
                          F.col("ord").alias("ord_j"), F.col("name").alias("concept_j"))
            .agg(F.count(F.lit(1)).alias("n_common")))


def concept_lists(concepts: DataFrame) -> DataFrame:
    """K9: concept -> sorted CUI list, as one row per concept (an export format;
    operators use the exploded ``(ord, name, cui)`` table)."""
    return (concepts.groupBy("ord", "name")
            .agg(F.sort_array(F.collect_set("cui")).alias("cuis")))


def term_labels(concepts: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Merged term mapping labels.

    ``(concept) term (idx)`` when the closure has more than one CUI, else
    ``(concept) term``; ``term`` defaults to the CUI itself.  ``idx`` numbers
    the CUIs of a concept in CUI order.
    """
    c = concepts
    if terms is not None:
        c = c.join(terms.select("cui", "term"), "cui", "left")
    else:
        c = c.withColumn("term", F.col("cui"))
    # numbering without a window over a whole (possibly huge) concept:
    # bucket by CUI prefix (monotone with CUI order), prefix sums of counts
    c = c.withColumn("_b", F.substring("cui", 1, 5))
    c = dense_rank_within(c, "name", ["cui"], "_b", "_idx")
    size = c.groupBy("name").agg(F.count(F.lit(1)).alias("_size"))
    c = c.join(size, "name")
    label = F.when(F.col("_size") > 1, F.format_string("(%s) %s (%d)", "name", "term", "_idx")) \
        .otherwise(F.format_string("(%s) %s", "name", "term"))
    return c.select("name", "cui", label.alias("label"))


def concepts_by_cui(concepts: DataFrame) -> DataFrame:
    """CUI -> names of the concepts holding it, in concept order (one row per CUI)."""
    return (concepts.groupBy("cui")
            .agg(F.sort_array(F.collect_set(F.struct("ord", "name"))).alias("_c"))
            .select("cui", F.transform("_c", lambda x: x["name"]).alias("concept_names")))


def tag_mentions(anns: DataFrame, concepts: DataFrame, reset: bool = False,
                 keep_untagged: bool = True) -> DataFrame:
    """Add every study concept whose closure holds the mention's CUI.

    The concept table is first folded to one row per CUI, so the mention table
    is joined once and never regrouped; Spark broadcasts the folded side when
    its measured size is under the broadcast threshold, else sort-merges.
    """
    by_cui = concepts_by_cui(concepts)
    j = anns.join(by_cui, "cui", "left" if keep_untagged else "inner")
    new = F.coalesce(F.col("concept_names"), F.array().cast("array<string>"))
    if "study_concepts" in anns.columns and not reset:
        tagged = F.array_distinct(F.concat(F.col("study_concepts"), new))
    else:
        tagged = new
    return j.withColumn("study_concepts", tagged).drop("concept_names")
