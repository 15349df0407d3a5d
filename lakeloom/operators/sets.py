"""Unions and de-duplication with a defined winner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins_union(parts: list[DataFrame], key: str, side: str) -> DataFrame:
    """The rows of all parts; of several with a key, the one of the first part.  ``side`` counts parts from 1.

    Rows are compared as one struct in an aggregate, so partial results are
    formed before the shuffle and no key is sorted.
    """
    names = [c for c in parts[0].columns if c != key]
    tagged = [p.withColumn(side, F.lit(i + 1)) for i, p in enumerate(parts)]
    whole = tagged[0]
    for p in tagged[1:]:
        whole = whole.unionByName(p)
    best = F.min(F.struct(side, *names)).alias("_row")
    return whole.groupBy(key).agg(best).select(key, *[F.col("_row")[c].alias(c) for c in (side, *names)])


def keep_best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def last_per_key(df: DataFrame, keys: list[str], n: int, *newest_first: Column) -> DataFrame:
    """The newest ``n`` rows of each key, as a bounded buffer would hold them."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
