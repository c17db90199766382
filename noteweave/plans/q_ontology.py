"""Registered queries: ontology tables (U1, U2), closure (U3, U7), lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ontology
from . import inputs
from .registry import register

SOURCES = ["MTH", "SNOMEDCT_US"]
PRUNE = ["C0000004", "C0000010", "C0000033"]
_SRC = ", ".join(f"'{s}'" for s in SOURCES)
_PRUNE = ", ".join(f"'{s}'" for s in PRUNE)

_EDGES_SQL = f"""ed as (select distinct cui1, cui2 from f_edge
  where rel in ('RN','CHD') and sab in ({_SRC}) and cui1 <> cui2 and cui1 <> '' and cui2 <> ''
  except select cui1, cui2 from f_edge where rel in ('RB','PAR') and sab in ({_SRC}))"""

_GROUPS_SQL = """cg as (select s.cui, g.tuigroup from f_sty s join f_semgroup g on s.tui = g.tui)"""


def _edges(spark, sf_dir):
    return ontology.narrower_edges(inputs.view(spark, sf_dir, "f_edge"), SOURCES, include_chd=True)


def _cui_tab(spark, sf_dir):
    return ontology.cui_table(inputs.view(spark, sf_dir, "f_sty"), inputs.view(spark, sf_dir, "f_semgroup"),
                              inputs.view(spark, sf_dir, "f_conso"))


def _roots(edges):
    return edges.select(F.col("cui1").alias("root")).distinct()


@register("edges_narrower", f"with {_EDGES_SQL} select cui1, cui2 from ed")
def edges_narrower(spark, sf_dir):
    """Narrower edges of the listed sources minus broader ones."""
    return _edges(spark, sf_dir)


@register("edges_rel", f"with {_EDGES_SQL} select cui1, 'RN' as has, string_agg(cui2, ',' order by cui2) as cui2 from ed group by cui1")
def edges_rel(spark, sf_dir):
    """U2d: rel.csv rows."""
    return ontology.rel_table(_edges(spark, sf_dir))


@register("onto_label", """select cui, arg_max(str, line_no) as cuilabel from f_conso
 where lat = 'ENG' and ts = 'P' and stt = 'PF' and ispref = 'Y' group by cui""")
def onto_label(spark, sf_dir):
    """Preferred English label per concept."""
    return ontology.preferred_labels(inputs.view(spark, sf_dir, "f_conso"))


@register("onto_snomed", """select code as snomed, arg_max(cui, line_no) as cui from f_conso
 where lat = 'ENG' and sab = 'SNOMEDCT_US' group by code""")
def onto_snomed(spark, sf_dir):
    """U1d: SNOMED code -> CUI."""
    return ontology.snomed_to_cui_table(inputs.view(spark, sf_dir, "f_conso"))


@register("onto_sty", "select tui, tuigroup, tuigrouplabel from f_semgroup")
def onto_sty(spark, sf_dir):
    """Semantic groups table."""
    return ontology.semantic_groups(inputs.view(spark, sf_dir, "f_semgroup"))


@register("onto_cui", """
select t.cui, t.tuis, g.tuigroups, coalesce(l.cuilabel, '') as cuilabel
from (select cui, string_agg(tui, ',' order by line_no) as tuis from f_sty group by cui) t
join (select s.cui, string_agg(distinct g.tuigroup, ',' order by g.tuigroup) as tuigroups
      from f_sty s join f_semgroup g on s.tui = g.tui group by s.cui) g on t.cui = g.cui
left join (select cui, arg_max(str, line_no) as cuilabel from f_conso
      where lat = 'ENG' and ts = 'P' and stt = 'PF' and ispref = 'Y' group by cui) l on t.cui = l.cui""")
def onto_cui(spark, sf_dir):
    """U1b + U1e: cui.csv rows (type list in file order, sorted groups, label)."""
    c = _cui_tab(spark, sf_dir)
    return c.select("cui", F.array_join("tuis", ",").alias("tuis"),
                    F.array_join("tuigroups", ",").alias("tuigroups"), "cuilabel")


@register("onto_lookup", """
select a.doc_id, a.ann_no, a.cui, coalesce(c.tuigroups, '') as tuigroups, coalesce(l.cuilabel, '') as cuilabel,
       s.snomed
from f_ann a
left join (select s.cui, string_agg(distinct g.tuigroup, ',' order by g.tuigroup) as tuigroups
           from f_sty s join f_semgroup g on s.tui = g.tui group by s.cui) c on a.cui = c.cui
left join (select cui, arg_max(str, line_no) as cuilabel from f_conso
           where lat = 'ENG' and ts = 'P' and stt = 'PF' and ispref = 'Y' group by cui) l on a.cui = l.cui
left join (select min(snomed) as snomed, cui from (select code as snomed, arg_max(cui, line_no) as cui from f_conso
           where lat = 'ENG' and sab = 'SNOMEDCT_US' group by code) group by cui) s on a.cui = s.cui""")
def onto_lookup(spark, sf_dir):
    """U5 (+U4 reversed): every mention with its CUI's type groups, label and a SNOMED code."""
    anns = inputs.annotations(spark, sf_dir).select("doc_id", "ann_no", "cui")
    looked = ontology.lookup_cui(anns, _cui_tab(spark, sf_dir))
    sn = (ontology.snomed_to_cui_table(inputs.view(spark, sf_dir, "f_conso"))
          .groupBy("cui").agg(F.min("snomed").alias("snomed")))
    return looked.join(sn, "cui", "left").select(
        "doc_id", "ann_no", "cui", F.array_join("tuigroups", ",").alias("tuigroups"), "cuilabel", "snomed")


@register("closure_full", f"""with recursive {_EDGES_SQL},
cl(root, cui) as (select distinct cui1, cui1 from ed union select cl.root, ed.cui2 from cl join ed on cl.cui = ed.cui1)
select root, cui from cl""")
def closure_full(spark, sf_dir):
    """Full narrower closure (self included) of every concept that has children."""
    e = _edges(spark, sf_dir)
    return ontology.narrower_closure(e, _roots(e)).select("root", "cui")


@register("closure_depth", f"""with recursive {_EDGES_SQL},
cl(root, cui, depth) as (select distinct cui1, cui1, 0 from ed
  union select cl.root, ed.cui2, cl.depth + 1 from cl join ed on cl.cui = ed.cui1 where cl.depth < 2)
select root, cui, cast(min(depth) as int) as depth from cl group by root, cui""")
def closure_depth(spark, sf_dir):
    """U3 with a depth limit of 2 (shortest distance per concept)."""
    e = _edges(spark, sf_dir)
    c = ontology.narrower_closure(e, _roots(e), depth=2)
    return c.select("root", "cui", F.col("depth").cast("int").alias("depth"))


@register("closure_same_group", f"""with recursive {_EDGES_SQL}, {_GROUPS_SQL},
cl(root, cui) as (select distinct cui1, cui1 from ed
  union select cl.root, ed.cui2 from cl join ed on cl.cui = ed.cui1
  where exists (select 1 from cg a join cg b on a.tuigroup = b.tuigroup where a.cui = cl.root and b.cui = ed.cui2))
select root, cui from cl""")
def closure_same_group(spark, sf_dir):
    """U3 keeping only concepts that share a semantic type group with the root."""
    e = _edges(spark, sf_dir)
    c = ontology.narrower_closure(e, _roots(e), same_group=True, cui_groups=_cui_tab(spark, sf_dir))
    return c.select("root", "cui")


@register("closure_pruned", f"""with recursive {_EDGES_SQL},
cl(root, cui) as (select distinct cui1, cui1 from ed
  union select cl.root, ed.cui2 from cl join ed on cl.cui = ed.cui1 where ed.cui2 not in ({_PRUNE}))
select root, cui from cl""")
def closure_pruned(spark, sf_dir):
    """U3 with a prune list (pruned concepts are neither returned nor descended)."""
    e = _edges(spark, sf_dir)
    return ontology.narrower_closure(e, _roots(e), prune=PRUNE).select("root", "cui")


@register("closure_sizes", f"""with recursive {_EDGES_SQL}, {_GROUPS_SQL},
fc(root, same_group, cui) as (
  select r.cui1, v.sg, r.cui1 from (select distinct cui1 from ed) r, (values (false), (true)) as v(sg)
  union select fc.root, fc.same_group, ed.cui2 from fc join ed on fc.cui = ed.cui1
  where not fc.same_group or exists (select 1 from cg a join cg b on a.tuigroup = b.tuigroup where a.cui = fc.root and b.cui = ed.cui2)),
lim(root, max_depth, same_group, cui, depth) as (
  select r.cui1, st.max_depth, st.same_group, r.cui1, 0 from (select distinct cui1 from ed) r,
    (values (2, false), (2, true), (1, false), (1, true), (0, false), (0, true)) as st(max_depth, same_group)
  union select lim.root, lim.max_depth, lim.same_group, ed.cui2, lim.depth + 1 from lim join ed on lim.cui = ed.cui1
  where lim.depth < lim.max_depth and (not lim.same_group or exists (
    select 1 from cg a join cg b on a.tuigroup = b.tuigroup where a.cui = lim.root and b.cui = ed.cui2)))
select root, 999 as max_depth, same_group, count(*) as n from fc group by root, same_group
union all
select root, cast(max_depth as int) as max_depth, same_group, count(distinct cui) as n from lim group by root, max_depth, same_group""")
def closure_sizes(spark, sf_dir):
    """Closure size per root at depths 999/2/1/0, with and without the type filter."""
    e = _edges(spark, sf_dir)
    s = ontology.expansion_sizes(e, _roots(e), _cui_tab(spark, sf_dir))
    return s.select("root", F.col("max_depth").cast("int").alias("max_depth"), "same_group", "n")


@register("study_closure", f"""with recursive {_EDGES_SQL},
cl(name, cui) as (select name, cui from f_study union select cl.name, ed.cui2 from cl join ed on cl.cui = ed.cui1)
select name, cui from cl""")
def study_closure(spark, sf_dir):
    """K3: each study concept's CUIs expanded by the transitive narrower closure."""
    return ontology.multi_source_closure(inputs.study(spark, sf_dir), _edges(spark, sf_dir), "name")
