"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation with map-side combining and an equi-join, so a hub
with a third of all edges is pre-aggregated before it is shuffled, and its join
rows can be split by adaptive execution. Each round is written to the shared
folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import saved


def _least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step over edges (u, v): each neighbour is tied to the least node seen."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if larger_only else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = near.join(least, "u")
    if larger_only:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return tied.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a root that has none: then the roots are the least nodes."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not seen.where("out > 1 or (out > 0 and into > 0)").limit(1).count()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of edges (u, v), component being the least
    reachable node. Nulls and loops link nothing; repeated edges count once."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    edges = saved(edges)
    for _ in range(rounds):
        if _stars(edges):
            break
        edges = saved(_least(_least(edges, True), False))
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
