"""Snapshots over time and what changed between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_snapshots(lineitem: DataFrame) -> DataFrame:
    """(l_partkey, day, price, variants, available): one snapshot per product and day."""
    return lineitem.groupBy("l_partkey", F.to_date("l_shipdate").alias("day")).agg(
        F.max("l_extendedprice").alias("price"), F.countDistinct("l_suppkey").alias("variants"), F.bool_or(F.col("l_returnflag") != "R").alias("available")
    )


def change_events(snapshots: DataFrame, key: str = "l_partkey", time: str = "day") -> DataFrame:
    """Flags for price, availability and variants that differ from the snapshot before; the first has none."""
    w = Window.partitionBy(key).orderBy(time)
    differs = lambda c: F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(False))
    return snapshots.select(key, time, "price", "available", "variants", differs("price").alias("price_changed"), differs("available").alias("availability_changed"), differs("variants").alias("variants_changed"))
