"""Graphs as tables of nodes and edges."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undirected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Both directions of every edge, each once."""
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct()


def degrees(both: DataFrame) -> DataFrame:
    return both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def reach(edges: DataFrame, seeds: DataFrame, hops: int, folder: str | None = None) -> DataFrame:
    """(node, hops): the nodes within so many steps along (a, b) edges of the seeds, with the least steps.

    Each hop joins only the nodes that are new.  Seeds with a column ``seed``
    are kept apart: (seed, node, hops), the steps from each seed.  With ``folder`` (shared by all
    executors) a hop's table is written there, so that lineage stays short.
    """
    spark = edges.sparkSession
    keys = [c for c in ("seed", "node") if c in seeds.columns]
    found = front = seeds.select(*keys).distinct().withColumn("hops", F.lit(0))
    for h in range(1, hops + 1):
        step = front.join(edges, F.col("node") == F.col("a")).select(*keys[:-1], F.col("b").alias("node")).distinct().join(found, keys, "left_anti").withColumn("hops", F.lit(h))
        if folder:
            path = f"{folder}/hop-{uuid.uuid4().hex}"
            step.write.parquet(path)
            step = spark.read.schema(step.schema).parquet(path)
        else:
            step = step.persist(StorageLevel.MEMORY_AND_DISK)  # or each later hop computes it again
        found, front = found.unionByName(step), step
    return found


def related(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other, shared): the nodes two steps from each of ``nodes``, with the number of shared neighbours."""
    steps = nodes.join(both, F.col("node") == F.col("a")).select("node", F.col("b").alias("via"))
    other = both.select(F.col("a").alias("via"), F.col("b").alias("other"))
    return steps.join(other, "via").where("other <> node").groupBy("node", "other").agg(F.count("*").alias("shared"))
