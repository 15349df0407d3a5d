"""Product records: fusing sources, variants, completeness, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import vocabulary as V
from lakeloom.operators.duplicates import duplicates, members
from lakeloom.operators.fusion import completeness, fuse_fields, fuse_variants
from lakeloom.plans.registry import query, table

SOURCES = list(V.SOURCE_PRIORITY.items())
PRIORITY_SQL = "CASE l_suppkey % 8 " + " ".join(f"WHEN {i} THEN {p}" for i, (_, p) in enumerate(SOURCES)) + " END"


def _priority():
    out = F.lit(0)
    for i, (_, p) in enumerate(SOURCES):
        out = F.when(F.col("l_suppkey") % 8 == i, p).otherwise(out)
    return out


@query(f"""WITH f AS (SELECT l_partkey, l_returnflag AS field, l_extendedprice AS value, {PRIORITY_SQL} AS priority, l_shipdate, l_orderkey, l_linenumber FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, field ORDER BY priority DESC, l_shipdate, l_orderkey, l_linenumber, value) AS r, count(*) OVER (PARTITION BY l_partkey, field) AS n FROM f),
c AS (SELECT l_partkey, field, count(DISTINCT value) - 1 AS conflicts FROM f GROUP BY 1, 2) SELECT l_partkey, field, value, priority, conflicts FROM r JOIN c USING (l_partkey, field) WHERE r = 1""")
def fused_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field of a product from its most trusted source, with the number of other values."""
    facts = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("field"), F.col("l_extendedprice").alias("value"), _priority().alias("priority"), "l_shipdate", "l_orderkey", "l_linenumber")
    return fuse_fields(facts, "l_partkey", "field", "value", "priority", ["l_shipdate", "l_orderkey", "l_linenumber"])


@query(f"""WITH v AS (SELECT l_partkey, l_suppkey, {PRIORITY_SQL} AS priority, l_shipdate, l_orderkey, l_linenumber, l_extendedprice AS price, l_quantity AS quantity FROM lineitem)
SELECT l_partkey, l_suppkey, priority, price, quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY priority DESC, l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, price DESC, quantity DESC) AS r FROM v) WHERE r = 1""")
def fused_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per variant: the latest of the most trusted source."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", _priority().alias("priority"), "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return fuse_variants(rows, ["l_partkey", "l_suppkey"], "priority", ["l_shipdate", "l_orderkey", "l_linenumber"], ["price", "quantity"])


COMPLETENESS_SQL = """v AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS n, count(DISTINCT CASE WHEN l_returnflag = 'N' THEN l_suppkey END) AS whole FROM lineitem GROUP BY 1),
c AS (SELECT p_partkey, 0.30 * ((CAST(p_name <> '' AS INT) + CAST(p_retailprice > 1000 AS INT) + CAST(coalesce(n, 0) > 0 AS INT) + CAST(p_brand <> 'Brand#1' AS INT)) / 4)
+ 0.20 * CASE WHEN coalesce(n, 0) > 0 THEN 0.4 * CAST(p_partkey % 3 = 0 AS INT) + 0.6 * whole / n ELSE CAST(p_partkey % 3 = 0 AS INT) END + 0.20 * CASE WHEN coalesce(n, 0) > 0 THEN whole / n ELSE CAST(p_retailprice > 1000 AS INT) END
+ 0.15 * ((CAST(p_type <> 'SMALL' AS INT) + CAST(p_size > 10 AS INT) + CAST(contains(p_name, 'red') AS INT)) / 3) + 0.10 * ((CAST(p_size % 2 = 0 AS INT) + CAST(p_size % 3 = 0 AS INT)) / 2) + 0.05 * least(1.0, length(p_name) * 10 / 200) AS score
FROM part LEFT JOIN v ON l_partkey = p_partkey)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    v = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("n"), F.countDistinct(F.when(F.col("l_returnflag") == "N", F.col("l_suppkey"))).alias("whole"))
    c, sku = F.col, (F.col("p_partkey") % 3 == 0).cast("int")
    some = F.coalesce("n", F.lit(0)) > 0
    score = completeness(
        [c("p_name") != "", c("p_retailprice") > 1000, some, c("p_brand") != "Brand#1"], F.when(some, 0.4 * sku + 0.6 * c("whole") / c("n")).otherwise(sku), F.when(some, c("whole") / c("n")).otherwise((c("p_retailprice") > 1000).cast("int")),
        [c("p_type") != "SMALL", c("p_size") > 10, F.contains("p_name", F.lit("red"))], [c("p_size") % 2 == 0, c("p_size") % 3 == 0], F.length("p_name") * 10, V.COMPLETENESS,
    )
    return table(spark, sf_dir, "part").join(v, "p_partkey", "left").select("p_partkey", "p_brand", score.alias("score"))


@query(f"WITH {COMPLETENESS_SQL} SELECT p_partkey, round(score, 4) AS score, round(score, 9) >= 0.72 AS complete, CASE WHEN round(score, 9) >= 0.85 THEN 'full' WHEN round(score, 9) >= 0.75 THEN 'partial' ELSE 'fallback' END AS mode FROM c")
def product_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of product records and the answer mode that it allows."""
    s = F.round("score", 9)
    return scored(spark, sf_dir).select("p_partkey", F.round("score", 4).alias("score"), (s >= V.COMPLETE_FROM).alias("complete"), F.when(s >= V.FULL_FROM, "full").when(s >= V.PARTIAL_FROM, "partial").otherwise("fallback").alias("mode"))


@query(f"""WITH {COMPLETENESS_SQL} SELECT p_brand, count(*) AS pages, round(avg(score), 4) AS average, count(*) FILTER (WHERE round(score, 9) >= 0.72) AS complete, count(*) FILTER (WHERE round(score, 9) >= 0.5 AND round(score, 9) < 0.72) AS partial,
count(*) FILTER (WHERE round(score, 9) < 0.5) AS poor FROM c JOIN part USING (p_partkey) GROUP BY 1""")
def completeness_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean completeness and its three classes by platform."""
    s = F.round("score", 9)
    return scored(spark, sf_dir).groupBy("p_brand").agg(F.count("*").alias("pages"), F.round(F.avg("score"), 4).alias("average"), F.count_if(s >= 0.72).alias("complete"), F.count_if((s >= 0.5) & (s < 0.72)).alias("partial"), F.count_if(s < 0.5).alias("poor"))


@query("""WITH t AS (SELECT p_partkey, p_brand, p_type, p_retailprice, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part), l AS (SELECT *, lag(p_partkey) OVER x AS other, lag(w) OVER x AS w2, lag(p_retailprice) OVER x AS price2 FROM t WINDOW x AS (PARTITION BY p_brand, p_type ORDER BY p_retailprice, p_partkey))
SELECT p_partkey, other, round(0.6 * len(list_intersect(w, w2)) / len(list_distinct(list_concat(w, w2))) + 0.2 * CASE WHEN abs(p_retailprice - price2) <= 0.01 * greatest(p_retailprice, price2) THEN 1 ELSE 0 END + 0.2, 4) AS similarity FROM l WHERE other IS NOT NULL""")
def neighbour_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, price and brand similarity of products next to each other in price, within brand and type."""
    x = Window.partitionBy("p_brand", "p_type").orderBy("p_retailprice", "p_partkey")
    words = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("w"))
    pairs = words.withColumns({"other": F.lag("p_partkey").over(x), "w2": F.lag("w").over(x), "price2": F.lag("p_retailprice").over(x)}).where("other IS NOT NULL")
    near = F.abs(F.col("p_retailprice") - F.col("price2")) <= 0.01 * F.greatest("p_retailprice", "price2")
    score = 0.6 * F.size(F.array_intersect("w", "w2")) / F.size(F.array_union("w", "w2")) + 0.2 * near.cast("int") + 0.2
    return pairs.select("p_partkey", "other", F.round(score, 4).alias("similarity"))


@query("""WITH s AS (SELECT DISTINCT l_partkey, l_suppkey % 8 AS source FROM lineitem), n AS (SELECT l_partkey, count(*) AS sources FROM s GROUP BY 1) SELECT source, count(*) AS pages, count(*) FILTER (WHERE sources > 1) AS shared FROM s JOIN n USING (l_partkey) GROUP BY 1""")
def source_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by extraction source, and how many of them have several: the list of sources exploded."""
    used = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.collect_set(F.col("l_suppkey") % 8).alias("sources"))  # eight at most
    return used.select(F.explode("sources").alias("source"), F.size("sources").alias("n")).groupBy("source").agg(F.count("*").alias("pages"), F.count_if(F.col("n") > 1).alias("shared"))


@query("""WITH m AS (SELECT p_partkey, unnest(list_filter([CASE WHEN p_retailprice <= 1000 THEN 'price' END, CASE WHEN p_brand = 'Brand#1' THEN 'brand' END, CASE WHEN p_size <= 10 THEN 'size' END, CASE WHEN p_type = 'SMALL' THEN 'type' END], lambda x: x IS NOT NULL)) AS field FROM part)
SELECT field, count(*) AS n FROM m GROUP BY 1""")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each field is missing."""
    c = F.col
    gaps = F.array(F.when(c("p_retailprice") <= 1000, "price"), F.when(c("p_brand") == "Brand#1", "brand"), F.when(c("p_size") <= 10, "size"), F.when(c("p_type") == "SMALL", "type"))
    return table(spark, sf_dir, "part").select(F.explode(F.filter(gaps, lambda x: x.isNotNull())).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no stock codes: none is given."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), F.lit("").alias("sku"))


@query()
def duplicate_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of products that are more than 0.85 similar, over all pairs."""
    return duplicates(_products(spark, sf_dir)).withColumn("similarity", F.round("similarity", 4))


@query()
def duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every product in ``duplicate_products``."""
    return members(_products(spark, sf_dir))
