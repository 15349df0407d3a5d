"""Memories of conversations: bounded lists that expire."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.registry import query, table
from lakeloom.storage import scratch_path
from lakeloom.streaming.lists import expiring_lists, run_lists

#: Entries of a memory, and the seconds that it lives from its last one.
KEPT, LIFE = 5, 3600


def timed_messages(messages: DataFrame) -> DataFrame:
    """(key, at, ts, item): messages have no times, so one of two hours by the conversation and 0 to 60 minutes a turn stand in."""
    minutes = F.col("conv_id") % 2 * 60 + F.col("turn") * (F.col("conv_id") % 7) * 10
    ts = F.timestamp_seconds(F.lit(1704067200) + minutes * 60)
    return messages.select(F.col("conv_id").alias("key"), F.col("turn").alias("at"), ts.alias("ts"), F.concat_ws(":", "turn", "role").alias("item"))


def _shown(lists: DataFrame) -> DataFrame:
    return lists.where(F.size("items") > 0).select("key", F.array_join("items", ",").alias("items"), F.unix_timestamp("last").alias("last"))


LISTS_SQL = f"""WITH e AS (SELECT conv_id AS key, turn, 1704067200 + 60 * (conv_id % 2 * 60 + turn * (conv_id % 7) * 10) AS ts, turn || ':' || role AS item FROM conversations),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, turn DESC, item DESC) AS back FROM e), p AS (SELECT *, coalesce(lag(ts) OVER (PARTITION BY key ORDER BY back) >= ts + {LIFE}, false) AS paused FROM b),
o AS (SELECT *, sum(paused::INT) OVER (PARTITION BY key ORDER BY back) AS older FROM p)
SELECT key, string_agg(item, ',' ORDER BY back DESC) AS items, max(ts) AS last FROM o WHERE older = 0 AND back <= {KEPT} GROUP BY 1 HAVING max(ts) + {LIFE} > (SELECT max(ts) FROM e)"""


@query(LISTS_SQL)
def expiring_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bounded memories that expire hold of each conversation at the time of the last message."""
    rows = timed_messages(table(spark, sf_dir, "conversations"))
    return _shown(expiring_lists(rows, KEPT, LIFE, F.lit(rows.agg(F.max("ts")).first()[0])))


@query(LISTS_SQL)
def streamed_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same memories kept by a stream with list state and timers."""
    schema = table(spark, sf_dir, "conversations").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque[t]")
    return _shown(run_lists(timed_messages(stream), KEPT, LIFE, scratch_path(spark, "memories")))
