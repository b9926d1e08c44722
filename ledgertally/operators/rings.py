"""Rings of a directed graph: its strongly connected components of two nodes or more.

Nodes that nothing comes from or goes to are in no ring and are trimmed, again and again, which leaves little of a ledger. In what is left every node takes the
largest name that reaches it for its colour. The node that a colour is named after is in a ring with all nodes of its colour that reach it, which a search backwards within
the colour finds. Rings found are taken out, and the rest goes on. Every step is a join of edges with the nodes that changed last, stored in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgertally.sources.scratch import stored


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges between nodes that edges lead to and from."""
    count = edges.count()
    while count:
        both = stored(edges.select(F.col("u").alias("node")).distinct().join(edges.select(F.col("v").alias("node")).distinct(), "node"), "both")
        ends = {end: both.withColumnRenamed("node", end) for end in "uv"}
        edges = stored(edges.join(ends["u"], "u", "left_semi").join(ends["v"], "v", "left_semi").select("u", "v"), "edges")
        before, count = count, edges.count()
        if count == before:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """node, colour: the largest name among the nodes that reach it, itself included."""
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    colours = stored(nodes.withColumn("colour", F.col("node")), "colours")
    changed = colours
    while not changed.isEmpty():
        sent = edges.join(changed.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.max("colour").alias("sent"))
        tried = stored(colours.join(sent, "node", "left").withColumn("new", F.coalesce(F.greatest("colour", "sent"), "colour")), "tried")
        changed = tried.where("new > colour").select("node", F.col("new").alias("colour"))
        colours = tried.select("node", F.col("new").alias("colour"))
    return colours


def _reaching_roots(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """node, colour of the nodes that reach the node their colour is named after."""
    of = {end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"of_{end}")) for end in "uv"}
    within = stored(edges.join(of["u"], "u").join(of["v"], "v").where("of_u = of_v").select("u", "v", F.col("of_u").alias("colour")), "within")
    newest = stored(colours.where("node = colour"), "roots")
    found = [newest]
    while not newest.isEmpty():
        known = reduce(DataFrame.union, found).select(F.col("node").alias("u"))
        back = within.join(newest.select(F.col("node").alias("v")), "v", "left_semi").select("u", "colour").distinct()
        newest = stored(back.join(known, "u", "left_anti").select(F.col("u").alias("node"), "colour"), "newest")
        found = [stored(reduce(DataFrame.union, [*found, newest]), "found")] if len(found) > 8 else [*found, newest]
    return reduce(DataFrame.union, found)


def rings(edges: DataFrame) -> DataFrame:
    """``node, ring`` of every node in a ring, which its smallest node names, from edges ``(u, v)``. Edges of a node to itself, repeated ones and those without an end don't matter."""
    rest = _trimmed(stored(edges.where("u <> v").select("u", "v").distinct(), "edges"))
    found = []
    while not rest.isEmpty():
        members = stored(_reaching_roots(rest, _coloured(rest)), "members")
        found.append(members)
        for end in "uv":
            rest = rest.join(members.select(F.col("node").alias(end)), end, "left_anti")
        rest = _trimmed(stored(rest.select("u", "v"), "rest"))
    if not found:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("ring")).limit(0)
    every = reduce(DataFrame.union, found)
    names = every.groupBy("colour").agg(F.min("node").alias("ring"), F.count("*").alias("size")).where("size > 1")
    return every.join(names, "colour").select("node", "ring")
