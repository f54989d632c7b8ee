"""Connected components of a graph of 64-bit ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import cut_lineage


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step that hangs neighbours on a node's smallest neighbour; ``a`` is the larger node of an edge before and after.

    The large step moves the larger neighbours, the small step the others and the node.
    """
    around = edges
    if large:
        around = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    least = cut_lineage(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))  # so that a hub's join can be split
    moved = around.join(least, "a").where("b > a" if large else "true").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return cut_lineage(moved.where("a <> b").distinct())


def settled(edges: DataFrame) -> bool:
    """Whether all edges lead straight to a root: no node has two, and none that has one is led to."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.out").alias("out"), F.max("e.into").alias("into"))
    return nodes.agg(F.count_if((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("into") == 1)))).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``a, b`` edges to ``key, root``: every node that has an edge, with the smallest node it reaches.

    Alternating large and small star steps; the number of rounds grows with the
    logarithm of the longest chain, and edges that lead to their roots already take
    none. Each step's edges are checkpointed, so that none is done twice.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not settled(edges):
        edges = star(star(edges, True), False)
    return edges.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct())
