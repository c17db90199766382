"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, component): every node of ``edges`` (a long, b long) with the smallest node it reaches.

    Each round's edges are written to ``folder``, so lineage stays short.  A node's neighbours are never
    gathered: a star is a minimum (combined before the shuffle) joined back to the edges, a join that
    Spark can split where one node has very many.  Rows with nulls and loops are ignored.
    """
    def joined(side: DataFrame, key: str, step: str) -> DataFrame:
        least = stored(side.groupBy(key).agg(F.min("v").alias("m")), folder, f"{step}-min")
        return side.join(least, key)

    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, folder, f"{name}-0")
    mark, n = None, 0
    while True:
        n += 1
        both = e.union(e.select("v", "u").toDF("u", "v"))
        far = joined(both, "u", f"{name}-{n}-large").select("v", F.least("m", "u").alias("w"), "u").filter("v > u and v <> w").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        far = stored(far, folder, f"{name}-{n}-large")
        near = joined(far, "u", f"{name}-{n}-small")
        near = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).distinct()
        e = stored(near, folder, f"{name}-{n}")
        new = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
