"""Filters, joins, lookups, set operations and listings over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators.sets import first_wins_union
from lakeloom.plans.registry import query, table


@query("""SELECT n_name AS plan, count(*) AS tenants, round(sum(c_acctbal), 2) AS revenue FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""")
def revenue_by_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring revenue of active tenants by plan."""
    active = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    plans = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("plan"))
    return active.join(plans, "c_nationkey").groupBy("plan").agg(F.count("*").alias("tenants"), F.round(F.sum("c_acctbal"), 2).alias("revenue"))


@query("""SELECT r_name AS family, n_name AS plan, count(c_custkey) AS tenants FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def tenants_by_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants of every plan, plans without any included."""
    plans = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return plans.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("r_name").alias("family"), F.col("n_name").alias("plan"), F.coalesce("n", F.lit(0).cast("long")).alias("tenants"))


@query("""SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 2) AS chars FROM conversations GROUP BY 1""")
def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by role."""
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("messages"), F.countDistinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 2).alias("chars"))


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000)""")
def tenants_with_open_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A semi join: tenants that have a large pending invoice."""
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").join(pending, "c_custkey", "left_semi")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')""")
def tenants_without_urgent_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anti join: tenants without an urgent pending invoice."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""WITH o AS (SELECT s_suppkey AS org, s_acctbal > 5000 AS flag FROM supplier WHERE s_suppkey % 3 = 0), p AS (SELECT n_nationkey, n_regionkey IN (1, 2) AS flag FROM nation WHERE n_nationkey % 2 = 0)
SELECT c_custkey, coalesce(o.flag, p.flag, false) AS enabled, CASE WHEN o.flag IS NOT NULL THEN 'org' WHEN p.flag IS NOT NULL THEN 'plan' ELSE 'default' END AS decided_by
FROM customer LEFT JOIN o ON o.org = c_custkey LEFT JOIN p ON p.n_nationkey = c_nationkey""")
def feature_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by the most specific level that sets one: tenant, plan, off."""
    own = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("c_custkey"), (F.col("s_acctbal") > 5000).alias("own"))
    plan = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").isin(1, 2).alias("plan"))
    joined = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(own, "c_custkey", "left").join(plan, "c_nationkey", "left")
    by = F.when(F.col("own").isNotNull(), "org").when(F.col("plan").isNotNull(), "plan").otherwise("default")
    return joined.select("c_custkey", F.coalesce("own", "plan", F.lit(False)).alias("enabled"), by.alias("decided_by"))


@query("""WITH s AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT c_custkey, coalesce(o_orderstatus, 'none') AS status, CASE WHEN o_orderstatus IN ('O', 'P') THEN c_mktsegment ELSE 'free' END AS plan FROM customer LEFT JOIN s ON o_custkey = c_custkey AND r = 1""")
def tenant_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest subscription decides a tenant's plan; without an active one it is the free plan."""
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(newest)).where("r = 1").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", F.coalesce("o_orderstatus", F.lit("none")).alias("status"), F.when(F.col("o_orderstatus").isin("O", "P"), F.col("c_mktsegment")).otherwise("free").alias("plan"))


@query("""SELECT source, count(*) AS chunks, max(doc_id) AS newest, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1 ORDER BY chunks DESC, source""")
def knowledge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and newest chunk by source."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.max("doc_id").alias("newest"), F.sum("n_chars").alias("chars")).orderBy(F.desc("chunks"), "source")


@query("""SELECT doc_id, source, CAST(CASE WHEN source = 'src7' THEN 0.95 ELSE 0.9 END AS DOUBLE) AS similarity FROM documents WHERE source ILIKE '%rc7%' OR source = 'src7' ORDER BY doc_id LIMIT 20""")
def chunks_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 chunks of a source, exact names above partial ones."""
    return table(spark, sf_dir, "documents").where(F.col("source").ilike("%rc7%") | (F.col("source") == "src7")).select("doc_id", "source", F.when(F.col("source") == "src7", 0.95).otherwise(0.9).alias("similarity")).orderBy("doc_id").limit(20)


@query("""SELECT doc_id, n_chars FROM documents WHERE text ILIKE '%licensed%' OR text ILIKE '%copyright%' OR text ILIKE '%http%'""")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that hold any of several keywords."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").where(text.ilike("%licensed%") | text.ilike("%copyright%") | text.ilike("%http%")).select("doc_id", "n_chars")


@query("""SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01' AND o_totalprice BETWEEN 1000 AND 200000""")
def invoices_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open dates, lists and ranges, pushed to the scan."""
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "F") & (day >= F.lit("1997-01-01").cast("timestamp_ntz")) & (day < F.lit("1997-02-01").cast("timestamp_ntz")) & F.col("o_totalprice").between(1000, 200_000)).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def invoice_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a listing."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


@query("""SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS completeness FROM supplier ORDER BY completeness DESC NULLS LAST, s_suppkey LIMIT 10""")
def most_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best, unknown values last."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("completeness")).orderBy(F.col("completeness").desc_nulls_last(), "s_suppkey").limit(10)


@query("""WITH a AS (SELECT doc_id, 1 AS side, 0.8 AS score FROM documents WHERE source = 'src1'), b AS (SELECT doc_id, 2 AS side, 0.5 AS score FROM documents WHERE lang = 'en')
SELECT doc_id, min(side) AS side, CAST(arg_min(score, side) AS DOUBLE) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result lists as one; where both have an id, the first list's row stays."""
    docs = table(spark, sf_dir, "documents")
    first = docs.where("source = 'src1'").select("doc_id", F.lit(0.8).alias("score"))
    return first_wins_union([first, docs.where("lang = 'en'").select("doc_id", F.lit(0.5).alias("score"))], "doc_id", "side")


@query("""SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def settled_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations on keys."""
    orders = table(spark, sf_dir, "orders")
    of = lambda s: orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey").intersect(of("F")).exceptAll(of("P").distinct())


@query("""SELECT c_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 5""")
def tenants_of_all_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups filtered by an aggregate; their distinct values as a sorted list."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return joined.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("priorities"), F.count("*").alias("n")).where(F.size("priorities") == 5)


@query("""SELECT p_partkey, list_sort(list(DISTINCT l_suppkey)) AS sources FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def shared_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that more than one source offers."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct()
    return pairs.join(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", "left_semi").groupBy("p_partkey").agg(F.sort_array(F.collect_list("l_suppkey")).alias("sources")).where(F.size("sources") > 1)


@query("""SELECT CAST(CASE WHEN GROUPING(r_name) = 1 THEN 'all' ELSE r_name END AS VARCHAR) AS family, coalesce(c_mktsegment, 'all') AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, c_mktsegment)""")
def balance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by family and segment with subtotals."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")).select(F.coalesce("r_name", F.lit("all")).alias("family"), F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), "n", "balance")
