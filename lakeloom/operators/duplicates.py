"""Products that are the same: an exact join of all pairs above a similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIMILAR = 0.85

#: Without an equal stock code only price, brand and a title overlap of 0.75 together pass SIMILAR; the join is a little wider.
OVERLAP = 0.74

#: Prices within a hundredth of each other lie in the same or in neighbouring steps of this width.
STEP = 0.0102


def _keyed(products: DataFrame) -> DataFrame:
    tokens = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)))
    price = F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    return products.select("id", tokens.alias("tokens"), F.lower(F.coalesce("brand", F.lit(""))).alias("brand"), price.alias("price"), F.coalesce("sku", F.lit("")).alias("sku"))


_KEY = ["tokens", "brand", "price", "sku"]


def _classes(products: DataFrame) -> DataFrame:
    return _keyed(products).groupBy(*_KEY).agg(F.min("id").alias("first"), F.max("id").alias("last"))


def members(products: DataFrame) -> DataFrame:
    """(id, class): products alike in title words, brand, price and stock code have the least id of them as their class."""
    return _keyed(products).join(_classes(products), _KEY).select("id", F.col("first").alias("class"))


def duplicates(products: DataFrame) -> DataFrame:
    """(a, b, similarity) of classes of (id, title, brand, price, sku): each pair of a member of ``a`` and one of ``b`` with a larger id.

    ``id`` is unique.  Similarity is 1 for equal stock codes, else 0.6 of the
    titles' Jaccard, 0.2 for prices within 1 % of the first and 0.2 for equal
    brands; pairs above SIMILAR are returned.
    """
    classes = _classes(products)
    side = lambda df, p: df.select([F.col(c).alias(f"{p}_{c}") for c in df.columns])
    in_order = F.col("a_first") < F.col("b_last")

    coded = classes.where("sku <> ''").select("first", "last", "sku")
    same = side(coded, "a").join(side(coded, "b"), F.col("a_sku") == F.col("b_sku")).where(in_order).select("a_first", "b_first", F.lit(1.0).alias("similarity"))

    priced = classes.where("brand <> '' AND price <> 0 AND NOT isnan(price) AND size(tokens) > 0")
    counts = priced.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranked = priced.select("first", F.explode("tokens").alias("token")).join(counts, "token").groupBy("first").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked"))
    size = F.size("ranked")
    rare = F.slice("ranked", F.lit(1), size - F.ceil(size * OVERLAP).cast("int") + 1)
    step = F.floor(F.when(F.col("price") < 1, F.col("price") - 1).otherwise(F.log(F.greatest("price", F.lit(1.0)))) / STEP)
    keyed = priced.join(ranked, "first").withColumn("step", step).withColumn("key", F.explode(F.transform(rare, lambda x: x["token"]))).drop("ranked")
    near = keyed.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    joined = side(keyed, "a").join(side(near, "b"), (F.col("a_key") == F.col("b_key")) & (F.col("a_brand") == F.col("b_brand")) & (F.col("a_step") == F.col("b_step"))).where(in_order)
    title = F.size(F.array_intersect("a_tokens", "b_tokens")) / F.size(F.array_union("a_tokens", "b_tokens"))
    close = F.abs(F.col("a_price") - F.col("b_price")) / F.greatest("a_price", F.lit(1.0)) < 0.01
    alike = joined.where(close).select("a_first", "b_first", F.least(F.lit(1.0), title * 0.6 + 0.2 + 0.2).alias("similarity")).where(F.col("similarity") > SIMILAR)
    return same.unionByName(alike).groupBy(F.col("a_first").alias("a"), F.col("b_first").alias("b")).agg(F.max("similarity").alias("similarity"))
