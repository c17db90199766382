"""Ontology preparation and expansion (U*).

Source tables (pipe-separated release files, see ``sources.ontology_files``):

* ``rel(cui1, rel, cui2, sab)``            -- MRREL
* ``conso(line_no, cui, lat, ts, stt, ispref, sab, code, str)`` -- MRCONSO
* ``sty(line_no, cui, tui)``               -- MRSTY
* ``semgroups(tui, tuigroup, tuigrouplabel)`` -- SemGroups

Outputs are the lookup tables ``cui``, ``rel``, ``snomed`` and ``sty`` plus the
transitive narrower closure.  The closure is an iterative breadth-first
search over an edge table for many roots at once: each round joins the
frontier to the edges, drops visited pairs with a left-anti join, and is
checkpointed to the shared checkpoint folder so that lineage stays short and
a lost executor recomputes one round, not the whole walk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: Deeper than any path: a walk without a depth limit.
NO_LIMIT = 2 ** 31 - 1


# ---------------------------------------------------------------- U1

def semantic_groups(semgroups: DataFrame) -> DataFrame:
    """``sty.csv`` rows ``(tui, tuigroup, tuigrouplabel)``, ordered by tui."""
    return semgroups.select("tui", "tuigroup", "tuigrouplabel").dropDuplicates(["tui"]).orderBy("tui")


def concept_types(sty: DataFrame) -> DataFrame:
    """Concept -> semantic types in file order."""
    return (sty.groupBy("cui")
            .agg(F.sort_array(F.collect_list(F.struct("line_no", "tui"))).alias("_t"))
            .select("cui", F.transform("_t", lambda x: x["tui"]).alias("tuis")))


def preferred_labels(conso: DataFrame) -> DataFrame:
    """English preferred label per concept (LAT=ENG, TS=P, STT=PF, ISPREF=Y); last line wins."""
    p = conso.where((F.col("lat") == "ENG") & (F.col("ts") == "P") & (F.col("stt") == "PF")
                    & (F.col("ispref") == "Y"))
    return p.groupBy("cui").agg(F.max_by("str", "line_no").alias("cuilabel"))


def snomed_to_cui_table(conso: DataFrame) -> DataFrame:
    """U1d: SNOMED code -> CUI from English SNOMEDCT_US rows; last line wins."""
    s = conso.where((F.col("lat") == "ENG") & (F.col("sab") == "SNOMEDCT_US"))
    return s.groupBy(F.col("code").alias("snomed")).agg(F.max_by("cui", "line_no").alias("cui"))


def cui_table(sty: DataFrame, semgroups: DataFrame, conso: DataFrame) -> DataFrame:
    """U1e: ``cui.csv``: type list, sorted distinct groups, label ('' if none).

    Only concepts that have a type are listed.
    """
    types = concept_types(sty)
    groups = (sty.join(semgroups.select("tui", "tuigroup"), "tui", "left")
              .groupBy("cui").agg(F.array_sort(F.collect_set("tuigroup")).alias("tuigroups")))
    labels = preferred_labels(conso)
    return (types.join(groups, "cui", "left").join(labels, "cui", "left")
            .select("cui", "tuis", F.coalesce("tuigroups", F.array().cast("array<string>")).alias("tuigroups"),
                    F.coalesce("cuilabel", F.lit("")).alias("cuilabel")))


# ---------------------------------------------------------------- U2

def _valid(rel: DataFrame, sources: Sequence[str] | None) -> DataFrame:
    r = rel.where(F.col("cui1").isNotNull() & F.col("cui2").isNotNull()
                  & (F.col("cui1") != "") & (F.col("cui2") != "") & (F.col("cui1") != F.col("cui2")))
    if sources:  # X23: an empty list keeps every source
        r = r.where(F.col("sab").isin(list(sources)))
    return r


def narrower_edges(rel: DataFrame, sources: Sequence[str] | None = None,
                   include_chd: bool = True) -> DataFrame:
    """Narrower edges (RN, and CHD if enabled) minus the concept's broader ones (RB, PAR)."""
    r = _valid(rel, sources)
    kinds = ["RN", "CHD"] if include_chd else ["RN"]
    nar = r.where(F.col("rel").isin(kinds)).select("cui1", "cui2").distinct()
    bro = r.where(F.col("rel").isin("RB", "PAR")).select("cui1", "cui2").distinct()
    return nar.join(bro, ["cui1", "cui2"], "left_anti")


def rel_table(edges: DataFrame) -> DataFrame:
    """U2d: ``rel.csv``: one row per concept, sorted comma list of children (empties dropped, X10).

    An export format: its row for a concept holds all of that concept's
    children by definition.  Every join in the library uses the exploded
    edge table instead.
    """
    return (edges.groupBy("cui1")
            .agg(F.array_join(F.array_sort(F.collect_set("cui2")), ",").alias("cui2"))
            .select("cui1", F.lit("RN").alias("has"), "cui2"))


# ---------------------------------------------------------------- U3

def closure_for_roots(roots: DataFrame, edges: DataFrame, cui_groups: DataFrame | None = None,
                      root_keys: Sequence[str] = (), starts: DataFrame | None = None,
                      same: tuple[int, Sequence[str], bool] | None = None) -> DataFrame:
    """U3 for many roots at once -> ``(*root_keys, root, cui, depth)``.

    Per root: ``qdepth`` limits the distance (0 = the root only), ``qstop``
    lists CUIs that are neither returned nor descended (never applied to the
    root), and ``qonlysty`` keeps only children that share a type group with
    the root (a failing child is not descended); it needs ``cui_groups``.
    Depth is the shortest distance (breadth-first); the walk goes on until the
    frontier is empty, so without a ``qdepth`` the closure is complete.
    ``same`` gives one (qdepth, qstop, qonlysty) for all roots in place of
    columns: a level then needs no join with the roots' settings.  The joins of
    a level are merge joins, so no side of them passes through the driver.
    """
    keys = list(root_keys) + ["root"]
    limit, stop, only = same or (NO_LIMIT, (), False)
    cols = roots.columns
    r = roots
    if "qdepth" not in cols:
        r = r.withColumn("qdepth", F.lit(NO_LIMIT))
    if "qstop" not in cols:
        r = r.withColumn("qstop", F.array().cast("array<string>"))
    if "qonlysty" not in cols:
        r = r.withColumn("qonlysty", F.lit(only))
    r = r.select(*keys, F.col("qdepth").cast("int").alias("qdepth"), "qstop", "qonlysty").dropDuplicates(keys)
    if cui_groups is not None:
        g = cui_groups.select(F.col("cui").alias("root"), F.col("tuigroups").alias("root_groups"))
        r = r.join(g, "root", "left")
    r = r.withColumn("root_groups", F.coalesce(
        F.col("root_groups") if cui_groups is not None else F.lit(None).cast("array<string>"),
        F.array().cast("array<string>")))
    if cui_groups is None and (only or "qonlysty" in cols) and not r.where("qonlysty").isEmpty():
        raise ValueError("qonlysty needs the type groups of the CUIs")
    spark = roots.sparkSession
    ensure_checkpoint_dir(spark)
    # the inputs of every level are materialised once, so a level only joins
    # the new frontier instead of re-deriving edges and groups from sources
    params = r.checkpoint()  # one row per root
    e = edges.select(F.col("cui1").alias("cui"), F.col("cui2").alias("child")).checkpoint()
    child_groups = (cui_groups.select(F.col("cui").alias("child"), F.col("tuigroups").alias("child_groups"))
                    .checkpoint() if cui_groups is not None else None)
    # every level is materialised once in the shared checkpoint folder; the
    # visited set is the union of those levels, so lineage stays one level deep
    if starts is None:
        level = params.select(*keys, F.col("root").alias("cui"), F.lit(0).alias("depth")).checkpoint()
    else:  # several start CUIs per root (multi-source walk)
        level = (starts.select(*[F.col(k).alias(k) for k in keys], F.col("cui").alias("cui"))
                 .dropDuplicates(keys + ["cui"]).withColumn("depth", F.lit(0)).checkpoint())
    levels = [level]
    depth = 0
    while True:
        depth += 1
        if depth > limit:
            break
        step = level.select(*keys, "cui").join(e.hint("merge"), "cui")
        if stop:
            step = step.where(~F.col("child").isin(list(stop)))
        if same is None or only:
            step = (step.join(params.where(F.col("qdepth") >= depth).hint("merge"), keys)
                    .where(~F.array_contains("qstop", F.col("child"))))
        if child_groups is not None and (same is None or only):
            step = (step.join(child_groups.hint("merge"), "child", "left")
                    .where(~F.col("qonlysty") | F.coalesce(
                        F.arrays_overlap("root_groups", "child_groups"), F.lit(False))))
        visited = levels[0].select(*keys, "cui")
        for lv in levels[1:]:
            visited = visited.unionByName(lv.select(*keys, "cui"))
        level = (step.select(*keys, F.col("child").alias("cui")).distinct()
                 .join(visited.hint("merge"), keys + ["cui"], "left_anti")
                 .withColumn("depth", F.lit(depth))).checkpoint()
        if level.isEmpty():
            break
        levels.append(level)
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def multi_source_closure(starts: DataFrame, edges: DataFrame, key: str = "name") -> DataFrame:
    """K3: per key, everything reachable from any of its start CUIs (starts included).

    One breadth-first walk per key with all its seeds as the first level (a
    concept's closure is the union of its seeds' closures), so shared parts
    of the graph are walked once per key, not once per seed.
    """
    roots = starts.select(F.col(key).alias("root")).distinct()
    seeds = starts.select(F.col(key).alias("root"), F.col("cui").alias("cui"))
    c = closure_for_roots(roots, edges, None, starts=seeds)
    return c.select(F.col("root").alias(key), "cui").distinct()


def narrower_closure(edges: DataFrame, roots: DataFrame, depth: int = NO_LIMIT,
                     prune: Sequence[str] = (), same_group: bool = False,
                     cui_groups: DataFrame | None = None) -> DataFrame:
    """U3 with one setting for every root in ``roots(root)``."""
    return closure_for_roots(roots.select("root").distinct(), edges, cui_groups, same=(depth, tuple(prune), same_group))


def expansion_sizes(edges: DataFrame, roots: DataFrame, cui_groups: DataFrame,
                    depths: Sequence[int] = (999, 2, 1, 0)) -> DataFrame:
    """Closure size per root, depth limit (999: none) and type filter.

    One walk per type filter, to the largest depth asked for; the sizes for
    smaller depths count its rows up to that depth.
    """
    limits = [(d, NO_LIMIT if d == 999 else d) for d in depths]
    # roots x filters without a join: an array literal, exploded
    r = (roots.select("root").distinct()
         .select("root", F.explode(F.array(F.lit(False), F.lit(True))).alias("qonlysty"))
         .withColumn("qdepth", F.lit(max(n for _, n in limits)))
         .withColumn("qstop", F.array().cast("array<string>"))
         .withColumn("same_group", F.col("qonlysty")))
    c = closure_for_roots(r, edges, cui_groups, root_keys=["same_group"])
    n = c.groupBy("root", "same_group").agg(
        *[F.sum((F.col("depth") <= n).cast("long")).alias(f"n{d}") for d, n in limits])
    sizes = F.array(*[F.struct(F.lit(d).alias("max_depth"), F.col(f"n{d}").alias("n")) for d, _ in limits])
    return n.select("root", "same_group", F.explode(sizes).alias("s")).select("root", "s.max_depth", "same_group", "s.n")


# ---------------------------------------------------------------- U4/U5

def lookup_snomed(codes: DataFrame, snomed: DataFrame, code_col: str = "snomed") -> DataFrame:
    """U4: add ``cui`` for a SNOMED code column (null if unknown)."""
    s = snomed.select(F.col("snomed").alias(code_col), "cui")
    return codes.join(s, code_col, "left")


def lookup_cui(rows: DataFrame, cui_tab: DataFrame) -> DataFrame:
    """Add type groups and label (empty when the CUI is unknown)."""
    c = cui_tab.select("cui", "tuigroups", "cuilabel")
    return (rows.join(c, "cui", "left")
            .withColumn("tuigroups", F.coalesce("tuigroups", F.array().cast("array<string>")))
            .withColumn("cuilabel", F.coalesce("cuilabel", F.lit(""))))
