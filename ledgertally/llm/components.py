"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

A large-star step ties, for every node, its larger neighbours to the smallest of it and its neighbours; a small-star step does so with
its smaller neighbours. Both keep the components, and in the end every node hangs on the smallest of its component. Edges and minima are
tables in the shared folder, written anew in each step, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgertally.llm.tables import stored


def _are_stars(edges: DataFrame) -> bool:
    """Whether every edge (u, v) leads from a node of one edge to a smaller one that no edge leads away from: nothing is left to do."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("away"), F.lit(0).alias("hub"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("away").alias("away"), F.max("hub").alias("hub"))
    return ends.filter("away > 1 or (away = 1 and hub = 1)").isEmpty()


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds to each edge the smallest of u and what u has on the other side. The minima are stored, so that a join may split a hub."""
    least = stored(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("least")), "least")
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    return _with_least(both).filter("v > u and v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    tied = _with_least(ordered)
    moved = tied.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(tied.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v): node, component (its smallest node), for every node with an edge to another one.

    Null ends and loops are no edges; repeated and reversed edges count once. Without an edge there is no row.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(now, "edges")
    while not _are_stars(now):
        now = stored(_small_star(stored(_large_star(now), "large")), "small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
