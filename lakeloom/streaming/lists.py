"""Lists by key that are bounded and expire: the newest entries of a memory, cache or log.

A list holds the newest ``limit`` entries of its key and lives ``seconds`` from
its last entry; an entry after a longer pause starts it anew.  Conversation
memories, semantic caches and logs of facts, episodes and feedback differ in the
two numbers alone.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LISTS = "key long, items array<string>, last timestamp"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def expiring_lists(entries: DataFrame, limit: int, seconds: int, as_of: Column | None = None) -> DataFrame:
    """(key, items, last) of (key, at, ts, item) as of a time: the lists of a whole table, oldest entry first.

    Entries are in the order of ``ts``, then ``at``.  Those with a null key or
    time are left out, a null item is kept as an empty one.  Without ``as_of``
    nothing is expired but by a later entry of the same key.  Only each key's
    newest ``limit`` rows are looked at: a pause before them can't matter.
    """
    rows = entries.where("key IS NOT NULL AND ts IS NOT NULL").select("key", "at", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("item", F.lit("")).alias("item"))
    newest = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("at"), F.desc("item"))
    some = rows.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= limit)
    paused = F.coalesce(F.lag("ts").over(newest) >= F.col("ts") + F.make_interval(secs=F.lit(seconds)), F.lit(False))
    own = some.withColumn("paused", paused.cast("int")).withColumn("older", F.sum("paused").over(newest.rowsBetween(Window.unboundedPreceding, 0))).where("older = 0")
    lists = own.groupBy("key").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("back", "item")))), lambda x: x["item"]).alias("items"), F.max("ts").alias("last"))
    return lists if as_of is None else lists.where(F.col("last") + F.make_interval(secs=F.lit(seconds)) > as_of)


class _Lists(StatefulProcessor):
    """The entries and the last time of a key, with a timer at which they expire; times are in microseconds."""

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.life = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "item string")
        self.last = handle.getValueState("last", "us long")

    def _timer(self, last: int) -> int:
        return -(-(last + self.life) // 1000)  # milliseconds, not before the end

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        items = [x[0] for x in self.items.get()] if self.items.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None:
            self.handle.deleteTimer(self._timer(last))
        for r in sorted(rows, key=lambda r: (r.us, r.at, r.item)):
            if last is not None and r.us >= last + self.life:
                items = []
            items = [*items, r.item][-self.limit :]
            last = r.us if last is None else max(last, r.us)
        self.items.put([(x,) for x in items])
        self.last.update((last,))
        self.handle.registerTimer(self._timer(last))
        yield Row(key=key[0], items=items, us=last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.last.get()[0]
        self.items.clear()
        self.last.clear()
        yield Row(key=key[0], items=[], us=last)

    def close(self) -> None:
        pass


def stream_expiring_lists(entries: DataFrame, limit: int, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """The streaming form of (key, at, ts, item): a key's list whenever it changes, and an empty one when it expires.

    A list expires when the watermark passes its last entry by ``seconds``.  An
    entry that comes later than the watermark allows is dropped; one that comes in
    a later batch than its time would have it is appended where it comes.  The
    session's state store must be RocksDB's (``state_store``).
    """
    rows = entries.where("key IS NOT NULL AND ts IS NOT NULL").select(F.col("key").cast("long").alias("key"), F.col("at").cast("long").alias("at"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"))
    found = rows.withWatermark("ts", delay).groupBy("key").transformWithState(_Lists(limit, seconds), "key long, items array<string>, us long", "Update", "EventTime")
    return found.select("key", "items", F.timestamp_micros("us").alias("last"))


def state_store(spark) -> None:
    """Let the session keep streaming state in RocksDB, which lists and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def run_lists(entries: DataFrame, limit: int, seconds: int, folder: str) -> DataFrame:
    """(key, items, last) after the stream has taken what it holds now; empty lists are those that expired.

    Each batch's changes are written to a folder of its own number, so a batch
    that is run again replaces what it wrote.
    """
    spark = entries.sparkSession
    state_store(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/lists/number={number}")

    stream_expiring_lists(entries, limit, seconds).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(f"{LISTS}, batch int").parquet(f"{folder}/lists/*")
    # In one batch a list can change and expire: the empty one is the later.
    newest = F.max_by(F.struct("items", "last"), F.struct("batch", F.size("items") == 0))
    return changes.groupBy("key").agg(newest.alias("x")).select("key", "x.items", "x.last")
