"""Usage, cost, quota and service-level reports over ``events`` and ``orders``.

``events`` stands for usage records: user_id for the tenant, event_type for the
model or usage type, value for the cost, ``props.k`` for the tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators.aggregate import exact_sum, index_percentiles, share
from lakeloom.plans.registry import query, table

TOKENS_SQL = "coalesce(try_cast(regexp_extract(props, '\"k\":\\s*(-?\\d+)', 1) AS BIGINT), 0)"


def tokens() -> Column:
    return F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))


def cost() -> Column:
    return F.round(F.sum("value"), 2)


@query(f"""SELECT event_type AS model, count(*) AS calls, CAST(sum({TOKENS_SQL}) AS BIGINT) AS tokens, round(sum(value), 2) AS cost
FROM events WHERE event_type IS NOT NULL AND strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1""")
def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and cost by model in a billing period."""
    in_period = (F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-02-01").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").where(in_period & F.col("event_type").isNotNull()).groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.sum(tokens()).alias("tokens"), cost().alias("cost"))


@query(f"""SELECT user_id AS tenant, strftime(ts, '%Y-%m') AS period, count(*) AS requests, CAST(sum({TOKENS_SQL}) AS BIGINT) AS tokens,
CAST(sum(CASE WHEN event_type = 'purchase' THEN {TOKENS_SQL} ELSE 0 END) AS BIGINT) AS large_model_tokens,
CAST(sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE {TOKENS_SQL} END) AS BIGINT) AS small_model_tokens,
round(sum(value), 2) AS cost, max(ts) AS last_used FROM events GROUP BY 1, 2""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meters by tenant and month; whatever isn't the large model counts as the small one."""
    large = F.col("event_type") == "purchase"
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("tenant"), F.date_format("ts", "yyyy-MM").alias("period")).agg(
        F.count("*").alias("requests"), F.sum(tokens()).alias("tokens"), F.sum(F.when(large, tokens()).otherwise(0)).alias("large_model_tokens"),
        F.sum(F.when(large, 0).otherwise(tokens())).alias("small_model_tokens"), cost().alias("cost"), F.max("ts").alias("last_used"),
    )


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events
WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-31' GROUP BY 1 ORDER BY 1""")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and users by day over the seven days before a given date."""
    as_of = F.lit("2024-01-31").cast("timestamp_ntz")
    recent = table(spark, sf_dir, "events").where((F.col("ts") >= as_of - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") < as_of))
    return recent.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).orderBy("day")


@query("""SELECT user_id, count(*) AS requests, count(*) FILTER (WHERE event_type = 'view') AS hits,
round(coalesce(count(*) FILTER (WHERE event_type = 'view') / nullif(count(*), 0), 0.0), 4) AS hit_rate FROM events GROUP BY 1""")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of requests that a cache answered, by tenant; 0 for none."""
    hit = F.col("event_type") == "view"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(hit).alias("hits"), F.round(share(hit), 4).alias("hit_rate"))


@query("""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high,
round(count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) / count(*), 4) AS rate FROM orders GROUP BY 1""")
def monthly_high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of high-risk records by calendar month."""
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.count("*").alias("n"), F.count_if(high).alias("high"), F.round(share(high), 4).alias("rate"))


@query("""SELECT user_id, count(*) AS requests, round(sum(value), 2) AS cost FROM events
WHERE strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1 ORDER BY cost DESC, user_id LIMIT 50""")
def top_tenants_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 tenants of highest cost in a period."""
    return table(spark, sf_dir, "events").where(F.date_format("ts", "yyyy-MM") == "2024-01").groupBy("user_id").agg(F.count("*").alias("requests"), cost().alias("cost")).orderBy(F.desc("cost"), "user_id").limit(50)


@query("""WITH u AS (SELECT user_id, sum(value) AS used FROM events GROUP BY 1), l AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 4000.0 WHEN 'MACHINERY' THEN 8000.0 END AS cap FROM customer)
SELECT user_id, round(used, 2) AS used, CAST(coalesce(cap, 2000.0) AS DOUBLE) AS allowed, round(100 * used / coalesce(cap, 2000.0), 1) AS percent, used >= 0.8 * coalesce(cap, 2000.0) AS soft,
used >= coalesce(cap, 2000.0) AS hard, round(greatest(0.0, coalesce(cap, 2000.0) - used), 2) AS remaining FROM u LEFT JOIN l ON c_custkey = user_id""")
def quota_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use against each tenant's plan limit, the free plan's where a tenant has none; limits and ties of ``percent`` are met by the exact sum."""
    used = table(spark, sf_dir, "events").groupBy("user_id").agg(exact_sum("value").alias("u"))
    plans = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment") == "BUILDING", 4000.0).when(F.col("c_mktsegment") == "MACHINERY", 8000.0).alias("cap"))
    allowed = F.coalesce("cap", F.lit(2000.0))
    return used.join(plans, "user_id", "left").select(
        "user_id", F.round("u", 2).alias("used"), allowed.alias("allowed"), F.round(100 * F.col("u") / allowed, 1).alias("percent"), (F.col("u") >= 0.8 * allowed).alias("soft"),
        (F.col("u") >= allowed).alias("hard"), F.round(F.greatest(F.lit(0.0), allowed - F.col("u")), 2).alias("remaining"),
    )


@query("""WITH r AS (SELECT user_id, event_id, ts, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS cents FROM events)
SELECT event_id, user_id, CAST(cents AS BIGINT) AS running_cents, CASE WHEN cents >= 200000 THEN 'hard' WHEN cents >= 160000 THEN 'soft' ELSE 'ok' END AS state FROM r""")
def running_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quota counter after each request, within tenant and month, in cents."""
    w = Window.partitionBy("user_id", F.date_format("ts", "yyyy-MM")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cents = F.sum(F.round(F.col("value") * 100).cast("long")).over(w)
    return table(spark, sf_dir, "events").select("event_id", "user_id", cents.alias("running_cents")).withColumn("state", F.when(F.col("running_cents") >= 200_000, "hard").when(F.col("running_cents") >= 160_000, "soft").otherwise("ok"))


@query("""WITH m AS (SELECT event_type, sum(value) AS c, count(*) AS n FROM events GROUP BY 1)
SELECT round(sum(c), 2) AS total, CAST(sum(n) AS BIGINT) AS requests, round(sum(c) / sum(n), 4) AS average, round(sum(c) / 30 * 30.44, 2) AS projected_month, round(100 * sum(c) / 500000, 2) AS budget_percent, arg_max(event_type, c) AS dearest FROM m""")
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, projection to a month, share of a budget, and the dearest model."""
    by_model = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("c"), F.count("*").alias("n"))
    return by_model.agg(
        F.round(F.sum("c"), 2).alias("total"), F.sum("n").alias("requests"), F.round(F.sum("c") / F.sum("n"), 4).alias("average"), F.round(F.sum("c") / 30 * 30.44, 2).alias("projected_month"),
        F.round(100 * F.sum("c") / 500_000, 2).alias("budget_percent"), F.max_by("event_type", "c").alias("dearest"),
    )


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, any_value(n) AS n, round(avg(value), 4) AS average, max(value) FILTER (WHERE i = least(n - 1, n * 50 // 100)) AS p50, max(value) FILTER (WHERE i = least(n - 1, n * 95 // 100)) AS p95,
max(value) FILTER (WHERE i = least(n - 1, n * 99 // 100)) AS p99, round(count(*) FILTER (WHERE value <= 200) / count(*), 4) AS sla_rate FROM r GROUP BY 1""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, percentiles by index (n p div 100 of the sorted values) and the share within the service level."""
    events = table(spark, sf_dir, "events")
    rest = events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("average"), F.round(share(F.col("value") <= 200), 4).alias("sla_rate"))
    return index_percentiles(events, "event_type", "value", (50, 95, 99)).join(rest, "event_type")


@query("""SELECT event_type AS metric, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 4) AS average FROM events
WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1""")
def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, extremes and mean of every metric in the last 24 hours of data."""
    events = table(spark, sf_dir, "events")
    last = events.agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("since"))
    recent = events.join(F.broadcast(last), F.col("ts") > F.col("since"))  # one row
    return recent.groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 4).alias("average"))


@query("""SELECT event_type AS error_type, count(*) AS n, max(ts) AS last_seen FROM events WHERE value > 100 GROUP BY 1 ORDER BY n DESC, error_type LIMIT 20""")
def error_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent error types."""
    return table(spark, sf_dir, "events").where("value > 100").groupBy(F.col("event_type").alias("error_type")).agg(F.count("*").alias("n"), F.max("ts").alias("last_seen")).orderBy(F.desc("n"), "error_type").limit(20)


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS pages, round(avg(value), 4) AS quality, count(*) FILTER (WHERE value >= 200) AS complete, count(*) FILTER (WHERE value < 50) AS poor FROM events GROUP BY 1""")
def quality_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts and mean quality."""
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("pages"), F.round(F.avg("value"), 4).alias("quality"), F.count_if(F.col("value") >= 200).alias("complete"), F.count_if(F.col("value") < 50).alias("poor"))


@query("""SELECT (SELECT count(*) FROM customer) AS tenants, (SELECT count(*) FROM supplier) AS users, (SELECT count(*) FROM orders WHERE o_orderstatus IN ('O', 'P')) AS active,
(SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus IN ('O', 'P')) AS revenue""")
def platform_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts across the platform, as one row."""
    active = F.col("o_orderstatus").isin("O", "P")
    tenants, users = (table(spark, sf_dir, t).agg(F.count("*").alias(n)) for t, n in (("customer", "tenants"), ("supplier", "users")))
    orders = table(spark, sf_dir, "orders").where(active).agg(F.count("*").alias("active"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    return tenants.crossJoin(users).crossJoin(orders)  # one row each


@query("""SELECT user_id, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) / count(*), 4) END AS satisfaction,
round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS escalation,
list_aggregate(list_filter([CASE WHEN count(*) FILTER (WHERE event_type = 'view') / count(*) > 0.22 THEN 'lower_threshold' END, CASE WHEN avg(value) < 100 THEN 'reingest_content' END,
CASE WHEN count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.15 THEN 'increase_top_k' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS advice FROM events GROUP BY 1""")
def tuning_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback rates by tenant and the tuning steps that they call for (null for none)."""
    rate = lambda *kinds: share(F.col("event_type").isin(*kinds))
    steps = F.filter(F.array(F.when(rate("view") > 0.22, "lower_threshold"), F.when(F.avg("value") < 100, "reingest_content"), F.when(rate("error") > 0.15, "increase_top_k")), lambda x: x.isNotNull())
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(rate("purchase", "signup"), 4).alias("satisfaction"), F.round(rate("error"), 4).alias("escalation"), F.nullif(F.array_join(steps, ","), F.lit("")).alias("advice"))


@query("""SELECT event_type AS name, count(*) AS spans, round(sum(value), 2) AS total_ms, '# TYPE ' || event_type || ' counter' AS line FROM events GROUP BY 1""")
def trace_and_metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span counts and durations by name, with the metric's text line."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("spans"), F.round(F.sum("value"), 2).alias("total_ms")).withColumn("line", F.format_string("# TYPE %s counter", "name"))
