"""Product data in pages' script states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.hydration import hydration_products
from lakeloom.plans.registry import query, table


def pages_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html): the pages, five of six with a product of ``part`` in a script state.

    The bundled pages carry no state, so it is put in from ``part``: the kind
    goes by the id, and the generic ones lie at 0 to 10 levels.
    """
    pages, part = table(spark, sf_dir, "pages"), table(spark, sf_dir, "part")
    variants = F.transform(F.sequence(F.lit(1), F.col("p_size") % 4 + 1), lambda i: F.struct(F.concat_ws("-", "p_partkey", i).alias("sku"), F.col("p_retailprice").alias("price"), i.cast("string").alias("option1")))
    variants = F.slice(variants, 1, F.col("p_size") % 4)
    product = F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("productType"), F.col("p_retailprice").alias("price"), variants.alias("variants")))
    kind, deep = F.col("page_id") % 6, (F.floor(F.col("page_id") / 6) % 11).cast("int")
    wrapped = F.concat(F.repeat(F.lit('{"a":'), deep), "product", F.repeat(F.lit("}"), deep))
    state = (
        F.when(kind == 0, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"product":'), "product", F.lit("}}}</script>")))
        .when(kind == 1, F.concat(F.lit('<script>window.__NUXT__ = {"data":[{"x":{"y":'), "product", F.lit("}}]};</script>")))
        .when(kind == 2, F.concat(F.lit('<script>window.product = {"product":'), "product", F.lit("};</script>")))
        .when(kind == 3, F.concat(F.lit("<script>window.__INITIAL_STATE__ = "), wrapped, F.lit("; </script>")))
        .when(kind == 4, F.concat(F.lit('<script type="application/json">{"n":1,"list":[1,[2],'), "product", F.lit("]}</script>")))
        .otherwise(F.lit(""))
    )
    own = part.select("p_partkey", product.alias("product"))
    return pages.join(own, F.pmod("page_id", F.lit(200)) == F.col("p_partkey")).select("page_id", F.concat("html", state).alias("html"))


@query("""WITH p AS (SELECT page_id, page_id % 6 AS kind, (page_id // 6) % 11 AS deep, part.* FROM pages JOIN part ON page_id % 200 = p_partkey), f AS (SELECT *, kind < 5 AND (kind <> 3 OR deep <= 8) AS found, p_size % 4 AS n FROM p)
SELECT page_id, CASE WHEN found THEN ['nextjs', 'nuxt', 'shopify_theme', 'generic_state', 'embedded_json'][kind + 1] END AS state, CAST(CASE WHEN NOT found THEN 0 WHEN n > 0 THEN 5 + 2 * n ELSE 4 END AS INTEGER) AS richness, CASE WHEN found THEN p_name END AS title,
CASE WHEN found THEN p_brand END AS brand, CASE WHEN found THEN p_type END AS product_type, CASE WHEN found THEN p_retailprice END AS price, CASE WHEN found AND n > 0 THEN array_to_string(list_transform(range(1, n + 1), lambda i: p_partkey || '-' || i || ':' || i), ',') END AS variants FROM f""")
def hydrated_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product found in every page's state, at most eight levels deep."""
    found = hydration_products(pages_with_state(spark, sf_dir))
    variants = F.concat_ws(",", F.transform("variants", lambda v: F.concat(v["sku"], F.lit(":"), v["options"]["option1"])))
    return found.select("page_id", "state", "richness", "title", "brand", "product_type", "price", F.when(F.col("variants").isNotNull(), variants).alias("variants"))
