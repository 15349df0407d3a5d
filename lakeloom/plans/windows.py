"""Ordered and windowed work: buffers, budgets, change tracking, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators.sets import keep_best, last_per_key
from lakeloom.operators.temporal import change_events, daily_snapshots
from lakeloom.plans.registry import query, table


@query("""SELECT * EXCLUDE r FROM (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place, 1 AS r FROM events) WHERE place <= 20""")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 events of every user."""
    return last_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], 20, F.desc("ts"), F.desc("event_id"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DISTINCT ON: the newest order per tenant and status."""
    return keep_best(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, turn, role, left(text, CASE role WHEN 'user' THEN 300 ELSE 100 END) AS text FROM r WHERE back <= 4""")
def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four turns of each conversation, cut by role."""
    cut = F.when(F.col("role") == "user", F.substring("text", 1, 300)).otherwise(F.substring("text", 1, 100))
    return last_per_key(table(spark, sf_dir, "conversations"), ["conv_id"], 4, F.desc("turn")).select("conv_id", "turn", "role", cut.alias("text"))


@query("""WITH s AS (SELECT conv_id, turn, role, length(text) // 4 AS tokens FROM conversations), r AS (SELECT *, sum(CASE WHEN role = 'system' THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM s)
SELECT conv_id, turn, role, CAST(tokens AS BIGINT) AS tokens FROM r WHERE role = 'system' OR used <= 400""")
def messages_in_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest messages that fit a token budget; system messages always stay."""
    used = F.sum(F.when(F.col("role") == "system", 0).otherwise(F.col("tokens"))).over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    counted = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.floor(F.length("text") / 4).alias("tokens")).withColumn("used", used)
    return counted.where("role = 'system' OR used <= 400").drop("used")


@query("""WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents)
SELECT source, doc_id, n_chars, CAST(used AS BIGINT) AS used FROM r WHERE used <= 20000""")
def context_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each source up to the first that overflows the budget; what follows it goes too."""
    used = F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", used.alias("used")).where("used <= 20000")


@query("""SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 6) AS recent_mean FROM events""")
def recent_price_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a profile's last values, at most eleven."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-10, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.avg("value").over(w), 6).alias("recent_mean"))


@query("""SELECT o_custkey, max(o_orderdate) AS last_run, max(o_orderdate) + INTERVAL 24 HOUR AS next_run FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING max(o_orderdate) + INTERVAL 24 HOUR <= TIMESTAMP '2001-01-01'""")
def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose interval since the last finished run is over at a given time."""
    last = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_run"))
    return last.withColumn("next_run", F.col("last_run") + F.expr("INTERVAL 24 HOURS")).where(F.col("next_run") <= F.lit("2001-01-01").cast("timestamp_ntz"))


SNAPSHOTS_SQL = """s AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice) AS price, count(DISTINCT l_suppkey) AS variants,
bool_or(l_returnflag <> 'R') AS available FROM lineitem GROUP BY 1, 2), p AS (SELECT *, lag(price) OVER w AS old_price, lag(variants) OVER w AS old_variants, lag(available) OVER w AS was_available FROM s WINDOW w AS (PARTITION BY l_partkey ORDER BY day))"""


@query(f"""WITH {SNAPSHOTS_SQL} SELECT l_partkey, day, price, available, variants, coalesce(price <> old_price, false) AS price_changed, coalesce(available <> was_available, false) AS availability_changed,
coalesce(variants <> old_variants, false) AS variants_changed FROM p""")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily product snapshots with what changed since the one before."""
    return change_events(daily_snapshots(table(spark, sf_dir, "lineitem")))


@query(f"""WITH {SNAPSHOTS_SQL} SELECT l_partkey, day, old_price, price, CASE WHEN old_price = 0 THEN NULL ELSE round((price - old_price) / greatest(old_price, 1) * 100, 1) + 0.0 END AS change_pct
FROM p WHERE old_price IS NOT NULL AND price <> old_price""")
def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price changes, in percent of the old price (of 1 at least)."""
    w = Window.partitionBy("l_partkey").orderBy("day")
    priced = daily_snapshots(table(spark, sf_dir, "lineitem")).select("l_partkey", "day", F.lag("price").over(w).alias("old_price"), "price")
    percent = F.when(F.col("old_price") != 0, F.round((F.col("price") - F.col("old_price")) / F.greatest("old_price", F.lit(1.0)) * 100, 1) + 0.0)
    return priced.where("old_price IS NOT NULL AND price <> old_price").withColumn("change_pct", percent)


@query("""WITH s AS (SELECT l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS day, bool_or(l_returnflag <> 'R') AS available FROM lineitem GROUP BY 1, 2, 3), p AS (SELECT *, lag(available) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY day) AS was FROM s)
SELECT l_partkey, l_suppkey, day, was, available FROM p WHERE was IS NOT NULL AND was <> available""")
def stock_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability changes of every variant."""
    seen = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day")).agg(F.bool_or(F.col("l_returnflag") != "R").alias("available"))
    w = Window.partitionBy("l_partkey", "l_suppkey").orderBy("day")
    return seen.withColumn("was", F.lag("available").over(w)).where("was IS NOT NULL AND was <> available").select("l_partkey", "l_suppkey", "day", "was", "available")


@query("""SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS last_question, arg_max(text, turn) FILTER (WHERE role = 'user') AS question, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS answer, count(*) AS turns FROM conversations GROUP BY 1""")
def episode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's last question and answer."""
    said = lambda role, x: F.when(F.col("role") == role, x)
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.max(said("user", F.col("turn"))).alias("last_question"), F.max_by(F.col("text"), said("user", F.col("turn"))).alias("question"),
        F.max_by(F.col("text"), said("assistant", F.col("turn"))).alias("answer"), F.count("*").alias("turns"),
    )
