"""Aggregations that reports share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    """The share of rows that meet a condition; 0 for no rows."""
    return F.coalesce(F.try_divide(F.count_if(condition), F.count("*")), F.lit(0.0))


def exact_sum(value: str) -> Column:
    """The sum of a double column, the same in whatever order and parts its rows are added.

    Values are added as decimals of twenty places.  Where one is no such number
    (not finite, 1e18 and more) or the sum isn't, they are added as doubles.
    """
    exact = F.col(value).try_cast("decimal(38,20)")
    return F.coalesce(F.when(F.count(value) == F.count(exact), F.try_sum(exact)).cast("double"), F.sum(value))


def index_percentiles(df: DataFrame, key: str, value: str, percents: tuple[int, ...]) -> DataFrame:
    """(key, n, p50, ...): the sorted value at index n p div 100 of each key.

    Equal values are counted first, so a window runs over a key's distinct
    values, and no key's values are gathered in one array.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy(key).orderBy(value))
    ranked = counts.select(key, value, "times", upto.alias("upto")).withColumn("n", F.sum("times").over(Window.partitionBy(key)))
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100))
    pick = lambda p: F.max(F.when((at(p) < F.col("upto")) & (at(p) >= F.col("upto") - F.col("times")), F.col(value)))
    return ranked.groupBy(key).agg(F.max("n").alias("n"), *[pick(p).alias(f"p{p}") for p in percents])
