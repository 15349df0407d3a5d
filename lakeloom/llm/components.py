"""Connected components of an edge table, by alternating stars, on the executors alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import join_few, materialise

#: A node with more neighbours than this is a hot key: its edges are joined where they lie, or salted.
HOT_NODE = 256


def _told_lowest(edges: DataFrame, hot: int) -> DataFrame:
    """(u, v, m): each edge with the smallest ``m`` among u and its ``v``s.  Partial minima come first, and no star meets in one task."""
    lowest = materialise(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree"), "lowest")
    many, few = lowest.where(F.col("degree") > hot).select("u", "m"), lowest.where(F.col("degree") <= hot).select("u", "m")
    if many.isEmpty():
        return edges.join(few, "u")
    told = materialise(join_few(edges, many, ["u"], hot, "v"), "told")
    return told.where("m IS NOT NULL").unionByName(told.where("m IS NULL").drop("m").join(few, "u"))


def connected_components(edges: DataFrame, rounds: int = 40, hot: int = HOT_NODE) -> DataFrame:
    """(node, component) for every node of (a, b) edges; a component is named by its smallest node.

    Each round joins every node's larger neighbours to its smallest neighbour
    (large star), then its smaller ones (small star), which ends with one star
    per component after about a logarithm of the longest path.  A round's edges
    are a table in the shared folder: its size never grows, and a lost executor
    costs one round at most.  The edges of nodes with more than ``hot``
    neighbours, such as the centres of stars, are never gathered by node.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_told_lowest(both, hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        told = _told_lowest(large, hot)
        small = told.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        e = materialise(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
