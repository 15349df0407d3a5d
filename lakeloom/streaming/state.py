"""Keyed state over event streams, and the batch forms that give the same rows.

The counters here are anchored: a window opens with a key's first event and
lasts a fixed time from there, unlike a tumbling window, which starts by the
clock.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ANCHORED = "key long, event_id long, ts timestamp, in_window long"


def _fold(events: pd.DataFrame, start: pd.Timestamp | None, count: int, seconds: int) -> tuple[pd.Series, pd.Timestamp | None, int]:
    """Places in the windows for events in order of time, one step a window; an event without a time has none and opens none."""
    times = events["ts"].to_numpy(dtype="datetime64[us]")
    known = np.flatnonzero(~np.isnat(times))
    times, places, at = times[known], np.zeros(len(known), dtype=np.int64), 0
    while at < len(times):
        if start is not None:
            stop = max(at, int(np.searchsorted(times, pd.Timestamp(start).to_datetime64() + np.timedelta64(seconds, "s"))))
            places[at:stop] = count + np.arange(1, stop - at + 1)
            count, at = count + stop - at, stop
        if at < len(times):
            start, count = pd.Timestamp(times[at]), 0
    out = pd.Series(pd.NA, index=range(len(events)), dtype="Int64")
    out.iloc[known] = places
    return out, start, count


def anchored_counts(events: DataFrame, seconds: int, key: str = "user_id") -> DataFrame:
    """(key, event_id, ts, in_window): each event's place in its anchored window, for a whole table.

    A window's start depends on the one before, so a key's events are folded in
    order: they are dealt by key and sorted by Spark, and streamed through in
    batches with three numbers of state, however many a key has.  An event
    without a time keeps its row and has a null place; null keys are one key.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, count = "", None, 0  # no key yet
        for batch in batches:
            placed = []
            for k, part in batch.groupby("key", sort=False, dropna=False):
                k = None if pd.isna(k) else k
                if k != now:
                    now, start, count = k, None, 0
                places, start, count = _fold(part, start, count, seconds)
                placed.append(places)
            if placed:
                yield batch.assign(in_window=pd.concat(placed).array)

    slim = events.select(F.col(key).alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return slim.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(run, ANCHORED)


def stream_anchored_counts(events: DataFrame, seconds: int, key: str = "user_id") -> DataFrame:
    """The streaming form: state is the open window's start and count, forgotten once the watermark has passed the window.

    An event that comes in a later batch than its time would have it counts in
    the window that is open when it comes, as places already given can't change.
    """

    def step(k: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        batch = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        places, start, count = _fold(batch, start, count, seconds)
        if start is not None:
            state.update((start, count))
            state.setTimeoutTimestamp(int(start.timestamp() * 1000) + seconds * 1000)
        yield batch.assign(key=k[0], in_window=places.array)[["key", "event_id", "ts", "in_window"]]

    slim = events.select(F.col(key).alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", f"{seconds} seconds")
    return slim.groupBy("key").applyInPandasWithState(step, ANCHORED, "start timestamp, count long", "append", GroupStateTimeout.EventTimeTimeout)


def read_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def meter(events: DataFrame) -> DataFrame:
    """Requests and cost (in cents, exactly) by tenant and month: one definition for tables and streams."""
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return events.groupBy(F.col("user_id").alias("tenant"), F.date_format("ts", "yyyy-MM").alias("period")).agg(F.count("*").alias("requests"), cents.alias("cents"))


def run_meters(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Run the meters over what the stream holds now; each batch's changed meters are appended, the newest of each counts."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/meters")

    stream = meter(read_event_stream(spark, sf_dir)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    changes = spark.read.parquet(f"{folder}/meters")
    return changes.groupBy("tenant", "period").agg(F.max_by("requests", "batch").alias("requests"), F.max_by("cents", "batch").alias("cents"))
