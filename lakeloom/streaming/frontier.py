"""A frontier of addresses over a stream: each is taken once, and given out once, the most urgent first.

The stream's own state drops addresses that were seen within a delay.  What is
left is kept by batch number, as is what each batch gave out, so a batch that
runs again gives the same addresses.

    folder/seen/number=N   (canonical, priority) first seen in batch N
    folder/given/number=N  (canonical, place) given out by batch N
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeloom.functions.classify import address_priority, canonical_address, skipped_address

SEEN, GIVEN = "canonical string, priority int, number int", "canonical string, place int, number int"


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")


def frontier_batch(batch: DataFrame, number: int, folder: str, size: int) -> None:
    """Take a batch of (canonical, priority) and give out the ``size`` most urgent that wait; ties go by address.

    An address that an earlier batch has seen, longer ago than the stream's state
    reaches back, is not seen again.
    """
    spark = batch.sparkSession
    one = batch.groupBy("canonical").agg(F.min("priority").cast("int").alias("priority"))
    if number:
        one = one.join(_read(spark, folder, "seen", SEEN).where(F.col("number") < number).select("canonical"), "canonical", "left_anti")
    one.write.mode("overwrite").parquet(f"{folder}/seen/number={number}")
    waiting = _read(spark, folder, "seen", SEEN).where(F.col("number") <= number)
    if number:
        waiting = waiting.join(_read(spark, folder, "given", GIVEN).where(F.col("number") < number).select("canonical"), "canonical", "left_anti")
    first = waiting.orderBy("priority", "canonical").limit(size).withColumn("place", (F.monotonically_increasing_id() + 1).cast("int"))  # one partition, in order
    first.select("canonical", "place").write.mode("overwrite").parquet(f"{folder}/given/number={number}")


def start_frontier(pages: DataFrame, folder: str, size: int = 20, remembered: str = "7 days", **trigger) -> StreamingQuery:
    """Start the frontier of a stream of (url, ts).  Skipped addresses and those without a time are left out."""
    rows = pages.where(F.col("url").isNotNull() & F.col("ts").isNotNull() & ~skipped_address(F.col("url")))
    found = rows.select(canonical_address(F.col("url")).alias("canonical"), address_priority(F.col("url")).alias("priority"), F.col("ts").cast("timestamp").alias("ts"))
    once = found.withWatermark("ts", remembered).dropDuplicatesWithinWatermark(["canonical"]).drop("ts")
    return once.writeStream.foreachBatch(lambda batch, number: frontier_batch(batch, number, folder, size)).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def given(spark: SparkSession, folder: str) -> DataFrame:
    """(canonical, place, number): what each batch gave out."""
    return _read(spark, folder, "given", GIVEN)
