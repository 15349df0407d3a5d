"""Health of retrieval and crawling, alerts, and small tools over requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators.aggregate import share
from lakeloom.plans.registry import query, table


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS requests, round(count(*) FILTER (WHERE value < 25) / count(*), 4) AS no_result_rate, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 4) AS keyword_hit_rate,
round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS escalation_rate, round(avg(value) FILTER (WHERE value >= 25), 4) AS mean_score FROM events GROUP BY 1""")
def retrieval_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of a day's requests in one pass."""
    value, kind = F.col("value"), F.col("event_type")
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("requests"), F.round(share(value < 25), 4).alias("no_result_rate"), F.round(share(kind == "click"), 4).alias("keyword_hit_rate"), F.round(share(kind == "error"), 4).alias("escalation_rate"),
        F.round(F.avg(F.when(value >= 25, value)), 4).alias("mean_score"),
    )


@query("""SELECT conv_id, count(*) AS answers, round(avg(length(text)), 2) AS mean_length, round(avg(CASE WHEN length(text) < 50 THEN 1 ELSE 0 END), 4) AS short_rate, count(*) FILTER (WHERE contains(lower(text), 'not')) AS negative FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and wording of each conversation's answers."""
    n = F.length("text")
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(
        F.count("*").alias("answers"), F.round(F.avg(n), 2).alias("mean_length"), F.round(share(n < 50), 4).alias("short_rate"), F.count_if(F.contains(F.lower("text"), F.lit("not"))).alias("negative")
    )


@query("""SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars, round(avg(length(html)), 2) AS mean_chars, count(*) FILTER (WHERE contains(html, '<article>')) AS articles FROM pages GROUP BY 1""")
def crawl_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, sizes and articles by host."""
    n = F.length("html")
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host")).agg(
        F.count("*").alias("pages"), F.sum(n).alias("chars"), F.round(F.avg(n), 2).alias("mean_chars"), F.count_if(F.contains("html", F.lit("<article>"))).alias("articles")
    )


@query("""WITH k AS (SELECT event_id, event_type, try_cast(regexp_extract(props, '"k":\\s*(-?\\d+)', 1) AS BIGINT) AS k FROM events) SELECT event_type, k, count(*) AS n FROM k WHERE k IS NOT NULL GROUP BY 1, 2""")
def json_path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows chosen and grouped by a JSON path."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).where("k IS NOT NULL").groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, event_id, ts, sum(CAST(round(value * 100) AS BIGINT)) OVER w AS now, sum(CAST(round(value * 100) AS BIGINT)) OVER w - CAST(round(value * 100) AS BIGINT) AS before FROM events WINDOW w AS (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id))
SELECT user_id, event_id, ts, CAST(now AS BIGINT) AS cents FROM r WHERE before < 90000 AND now >= 90000""")
def budget_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request with which a tenant's month crosses nine tenths of its budget."""
    w = Window.partitionBy("user_id", F.date_format("ts", "yyyy-MM")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    own = F.round(F.col("value") * 100).cast("long")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.sum(own).over(w).alias("cents"), own.alias("own"))
    return rows.where("cents - own < 90000 AND cents >= 90000").drop("own")


@query("""WITH r AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, any_value(n) AS messages, count(*) FILTER (WHERE back <= 5) AS kept, CAST(sum(CASE WHEN back > 5 THEN length(text) ELSE 0 END) AS BIGINT) AS compressed_chars, any_value(n) > 5 AS compressed FROM r GROUP BY 1""")
def conversation_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bounded memory keeps of each conversation, and how much is left to a summary."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.length("text").alias("size"), back.alias("back"))
    older = F.sum(F.when(F.col("back") > 5, F.col("size")).otherwise(0))
    return rows.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("back") <= 5).alias("kept"), older.alias("compressed_chars"), (F.count("*") > 5).alias("compressed"))


@query("""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<meta [^>]*>')) AS tag FROM pages), p AS (SELECT page_id, lower(regexp_extract(tag, '(?i)<meta\\s+([a-z-]+)=', 1)) AS name FROM m) SELECT name, count(*) AS n, count(DISTINCT page_id) AS pages FROM p GROUP BY 1""")
def meta_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes that pages' meta tags begin with."""
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?i)<meta [^>]*>"), 0)).alias("tag"))
    return tags.groupBy(F.lower(F.regexp_extract("tag", r"(?i)<meta\s+([a-z-]+)=", 1)).alias("name")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("""WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)href="(/[^"]*)"', 1))) AS target FROM pages) SELECT target, count(*) AS pages, min(page_id) AS first_page FROM l GROUP BY 1""")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local link targets with the pages that hold them."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('(?i)href="(/[^"]*)"'), 1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("target")).groupBy("target").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_quantity >= 10 THEN 'normal' ELSE 'small' END AS tier,
CASE l_linestatus WHEN 'F' THEN 0 ELSE CASE WHEN l_quantity >= 40 THEN 7 ELSE 3 END END AS days, l_shipdate FROM lineitem""")
def order_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices after discount and tax, the quantity's tier and the days of delivery."""
    c = F.col
    bulk = c("l_quantity") >= 40
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax")), 6).alias("charge"), F.when(bulk, "bulk").when(c("l_quantity") >= 10, "normal").otherwise("small").alias("tier"),
        F.when(c("l_linestatus") == "F", 0).when(bulk, 7).otherwise(3).alias("days"), "l_shipdate",
    )


@query("""WITH s AS (SELECT l_partkey, avg(l_extendedprice) AS seen, count(*) AS n FROM lineitem GROUP BY 1) SELECT p_partkey, n, list_filter([CASE WHEN abs(p_retailprice * 25 - seen) > 0.05 * p_retailprice * 25 THEN 'price' END, CASE WHEN n < 20 THEN 'few_sources' END], lambda x: x IS NOT NULL) AS flags FROM part JOIN s ON l_partkey = p_partkey""")
def answer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose observed price is off by more than a twentieth, or that rest on few facts."""
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_extendedprice").alias("seen"), F.count("*").alias("n"))
    expected = F.col("p_retailprice") * 25
    flags = F.array(F.when(F.abs(expected - F.col("seen")) > 0.05 * expected, "price"), F.when(F.col("n") < 20, "few_sources"))
    return table(spark, sf_dir, "part").join(seen, "p_partkey").select("p_partkey", "n", F.filter(flags, lambda x: x.isNotNull()).alias("flags"))


@query("""WITH t AS (SELECT doc_id, lang, source, n_chars, ntile(4) OVER (ORDER BY n_chars, doc_id) AS q FROM documents) SELECT lang, q AS quartile, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high FROM t GROUP BY 1, 2""")
def length_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and quartile of length.

    Quartile borders come from counts by length (a small table), so no window
    runs over all documents in one task.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    sizes = docs.groupBy("n_chars").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1))
    ranks = sizes.select("n_chars", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("n_chars").orderBy("doc_id")) - 1
    big = F.floor(F.col("all") / 4) + 1
    larger = F.col("all") % 4  # so many quartiles hold one row more
    quartile = F.when(F.col("p") < big * larger, F.floor(F.col("p") / big)).otherwise(larger + F.floor((F.col("p") - big * larger) / F.floor(F.col("all") / 4))) + 1
    return docs.join(ranks, "n_chars").withColumn("p", place).select("lang", quartile.cast("long").alias("quartile"), "n_chars").groupBy("lang", "quartile").agg(F.count("*").alias("n"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))
