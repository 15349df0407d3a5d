"""Variants resolved from several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions.vocabulary import SOURCE_PRIORITY
from lakeloom.operators.variants import STOCK_SOURCES, confidence_summary, resolved_variants
from lakeloom.plans.registry import query, table
from lakeloom.plans.texts import s

#: What suppliers and line numbers stand for.
SOURCES = [*SOURCE_PRIORITY, "inventory_api", "other"]
_ORDER = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")


def variant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as what a source says of a variant; some have no stock code, title, price, availability or stock."""
    c, names = F.col, F.array(*map(F.lit, SOURCES))
    line = table(spark, sf_dir, "lineitem").withColumn("position", F.row_number().over(Window.partitionBy("l_partkey").orderBy(*_ORDER)))
    return line.select(
        c("l_partkey").alias("product"), "position", F.get(names, ((c("l_linenumber") + c("l_suppkey")) % len(SOURCES)).cast("int")).alias("source"),
        F.when(c("l_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("S"), c("l_suppkey") % 7)).alias("sku"), F.when(c("l_quantity") % 3 == 0, "").otherwise(F.concat(F.lit("Size "), (c("l_quantity") % 4).cast("int"))).alias("title"),
        F.when(c("l_quantity") % 4 != 0, c("l_extendedprice")).alias("price"), F.lit("").alias("currency"), F.when(c("l_returnflag") == "R", False).when(c("l_returnflag") == "N", True).alias("available"),
        F.when(c("l_linenumber") % 2 == 0, c("l_quantity").cast("long")).alias("stock"), F.create_map(c("l_linestatus"), c("l_linenumber").cast("string")).alias("options"), F.when(c("l_linestatus") == "O", F.concat(F.lit("B"), "l_linenumber")).alias("barcode"),
        c("l_discount").alias("weight"), F.lit("").alias("image_url"),
    )


_PRIORITY = "CASE source " + " ".join(f"WHEN {s(k)} THEN {v}" for k, v in SOURCE_PRIORITY.items()) + " ELSE 0 END"


@query(f"""WITH l AS (SELECT l_partkey AS product, row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(_ORDER)}) AS position, [{", ".join(map(s, SOURCES))}][(l_linenumber + l_suppkey) % {len(SOURCES)} + 1] AS source, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE 'S' || (l_suppkey % 7) END AS sku,
CASE WHEN l_quantity % 3 = 0 THEN '' ELSE 'Size ' || CAST(l_quantity % 4 AS INT) END AS title, CASE WHEN l_quantity % 4 <> 0 THEN l_extendedprice ELSE 0 END AS price, CASE l_returnflag WHEN 'R' THEN false WHEN 'N' THEN true END AS available, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) END AS stock,
CASE WHEN l_linestatus = 'O' THEN 'B' || l_linenumber ELSE '' END AS barcode, l_discount AS weight, l_linestatus AS option, l_linenumber AS value FROM lineitem),
k AS (SELECT *, {_PRIORITY} AS priority, CASE WHEN sku <> '' THEN 'sku:' || sku WHEN title <> '' THEN 'title:' || lower(title) ELSE 'row:' || position END AS key FROM l), o AS (SELECT *, row_number() OVER (PARTITION BY product, key ORDER BY priority DESC, position) AS n FROM k),
g AS (SELECT product, key, any_value(sku) AS sku, arg_min(title, n) FILTER (WHERE title <> '') AS title, arg_min(price, n) FILTER (WHERE price <> 0) AS price, arg_min(source, n) FILTER (WHERE price <> 0) AS price_source, arg_min(barcode, n) FILTER (WHERE barcode <> '') AS barcode,
arg_min(weight, n) FILTER (WHERE n = 1 AND weight <> 0) AS w_base, arg_min(weight, n) FILTER (WHERE n > 1 AND priority > 0 AND weight <> 0) AS w_known, arg_min(weight, n) FILTER (WHERE n > 1 AND weight <> 0) AS w_any, coalesce(any_value(available) FILTER (WHERE n = 1), true) AS own,
arg_min(available, n) FILTER (WHERE n > 1 AND priority > 0 AND source <> 'inventory_api' AND available IS NOT NULL) AS next, arg_max(available, n) FILTER (WHERE source = 'inventory_api' AND available IS NOT NULL AND n > 1) AS told, max(n) FILTER (WHERE source = 'inventory_api') AS last,
arg_max(stock, n) FILTER (WHERE n > 1 AND stock IS NOT NULL AND source IN ({", ".join(map(s, STOCK_SOURCES))})) AS later_stock, any_value(stock) FILTER (WHERE n = 1) AS base_stock, arg_min(value, n) FILTER (WHERE option = 'O') AS opened, arg_min(value, n) FILTER (WHERE option = 'F') AS finished FROM o GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN told IS NOT NULL THEN told WHEN NOT own AND next IS NOT NULL THEN next ELSE own END AS merged FROM g)
SELECT m.product, m.key, coalesce(m.title, '') AS title, coalesce(m.price, 0) AS price, price_source, coalesce(m.barcode, '') AS barcode, coalesce(w_known, w_base, w_any, 0) AS weight, CASE WHEN m.sku <> '' AND last IS NOT NULL THEN coalesce(o.available, merged) ELSE merged END AS available,
coalesce(CASE WHEN m.sku <> '' THEN o.stock END, later_stock, base_stock) AS stock, CAST(opened AS VARCHAR) AS opened, CAST(finished AS VARCHAR) AS finished, CAST(coalesce(w_known <> w_base, false)::INT AS INTEGER) AS conflicts FROM m LEFT JOIN o ON o.product = m.product AND o.key = m.key AND o.n = m.last""")
def resolved_product_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants of all products, each field from the source that is to be believed."""
    found = resolved_variants(variant_records(spark, sf_dir))
    return found.select("product", "key", "title", "price", F.col("sources")["price"].alias("price_source"), "barcode", "weight", "available", "stock", F.col("options")["O"].alias("opened"), F.col("options")["F"].alias("finished"), F.size("conflicts").alias("conflicts"))


@query()
def variant_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the variants of each product are to be believed."""
    return confidence_summary(resolved_variants(variant_records(spark, sf_dir)))
