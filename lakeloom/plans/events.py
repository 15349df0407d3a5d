"""Event-time windows, anchored counters, retention and state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.registry import query, table
from lakeloom.session import shared_folder
from lakeloom.sources.files import latest_state
from lakeloom.streaming.state import anchored_counts, meter, run_meters


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2""")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour."""
    w = F.window("ts", "1 hour")
    return table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")


@query("""WITH b AS (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS start, user_id FROM events) SELECT start, count(*) AS n, count(DISTINCT user_id) AS users FROM b GROUP BY 1""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two hours that start every hour."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "n", "users")


@query("""WITH l AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM g GROUP BY user_id, s""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after six idle hours."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


ANCHORED_SQL = """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, ts, i, ts AS start, 1 AS n FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.ts, o.i, CASE WHEN o.ts - w.start >= INTERVAL 86400 SECOND THEN o.ts ELSE w.start END, CASE WHEN o.ts - w.start >= INTERVAL 86400 SECOND THEN 1 ELSE w.n + 1 END
FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)"""


@query(f"{ANCHORED_SQL} SELECT user_id AS key, event_id, CAST(n AS BIGINT) AS in_window, n > 4 AS over_limit FROM w")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's place in its user's window (a day from the first request), and whether it is over the limit."""
    return anchored_counts(table(spark, sf_dir, "events"), 86_400).select("key", "event_id", "in_window", (F.col("in_window") > 4).alias("over_limit"))


METER_SQL = "SELECT user_id AS tenant, strftime(ts, '%Y-%m') AS period, count(*) AS requests, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2"


@query(METER_SQL)
def meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and cost by tenant and month."""
    return meter(table(spark, sf_dir, "events"))


@query(METER_SQL)
def streamed_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same meters kept by a stream over the same files."""
    return run_meters(spark, sf_dir, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


@query("""SELECT CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'purge' WHEN ts < TIMESTAMP '2024-01-20' THEN 'archive' ELSE 'keep' END AS action, count(*) AS n, min(ts) AS first_seen FROM events GROUP BY 1""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean-up would purge, archive and keep at a given date."""
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    action = F.when(F.col("ts") < at("2024-01-10"), "purge").when(F.col("ts") < at("2024-01-20"), "archive").otherwise("keep")
    return table(spark, sf_dir, "events").groupBy(action.alias("action")).agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"))


@query("""SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def subscription_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each tenant as its state."""
    return latest_state(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")


@query("""WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, arg_max(event_type, (n, event_type)) AS favourite, CAST(sum(n) AS BIGINT) AS events FROM t GROUP BY 1""")
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's most frequent kind of event."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.max(F.struct("n", "event_type")).alias("b"), F.sum("n").alias("events")).select("user_id", F.col("b.event_type").alias("favourite"), "events")
