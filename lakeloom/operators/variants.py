"""Variants of products, resolved from what several sources say of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lakeloom.functions.vocabulary import SOURCE_PRIORITY

# How far a source is trusted, other sources, and who knows of stock.
SOURCE_CONFIDENCE = {"shopify_json": 1.00, "graphql": 0.95, "xhr_api": 0.90, "inventory_api": 0.98, "jsonld": 0.80, "hydration": 0.70, "dom": 0.50, "llm": 0.15}
OTHER_CONFIDENCE, LOW_CONFIDENCE = 0.5, 0.5
INVENTORY, STOCK_SOURCES = "inventory_api", ("inventory_api", "xhr_api", "graphql")
# End of the fixed values.

TEXTS, NUMBERS = ("currency", "barcode", "image_url"), ("price", "weight")


def _by_source(values: dict[str, float], other: float) -> Column:
    known = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.element_at(known, F.col("source")), F.lit(other))


def records(rows: DataFrame) -> DataFrame:
    """The rows with ``key``, the variant they speak of, ``order``, ``base`` (the first of the variant) and the variant's ``options``, nulls as empty values.

    A record comes once for each of its own options (``option``), once with null if
    it has none.  One sort serves the windows and the grouping after them, and rows
    that lie by product are not shuffled.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    plain_number = lambda c: F.col(c) if rows.schema[c].dataType == DoubleType() else F.regexp_replace(F.col(c).cast("string"), ",", "").try_cast("double")
    plain = rows.select(
        "product", "position", F.coalesce("source", F.lit("")).alias("source"), text("sku").alias("sku"), text("title").alias("title"), *(text(c).alias(c) for c in TEXTS), *(F.coalesce(plain_number(c), F.lit(0.0)).alias(c) for c in NUMBERS),
        F.col("available").cast("boolean").alias("available"), F.col("stock").cast("long").alias("stock"), F.explode_outer("options").alias("option", "option_value"),
    )
    named = F.lower(F.regexp_replace("title", r"\s+", " "))
    key = F.when(F.col("sku") != "", F.concat(F.lit("sku:"), "sku")).when(F.col("title") != "", F.concat(F.lit("title:"), named)).otherwise(F.concat(F.lit("row:"), "position"))
    told = plain.withColumn("key", key).withColumn("priority", _by_source(SOURCE_PRIORITY, 0).cast("int")).withColumn("order", F.struct((-F.col("priority")).alias("p"), "position"))
    by_option = Window.partitionBy("product", "key").orderBy("option", F.desc("priority"), "position")
    variant = by_option.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = told.select("*", F.min("order").over(variant).alias("first"), F.lag("option").over(by_option).alias("before"))
    opening = F.when(F.col("option").isNotNull() & ~F.col("option").eqNullSafe(F.col("before")), F.struct("option", "option_value"))  # the variant's first record with the option
    whole = seen.withColumn("options", F.map_from_entries(F.collect_list(opening).over(variant)))
    return whole.withColumn("base", F.col("order") == F.col("first")).withColumn("confidence", _by_source(SOURCE_CONFIDENCE, OTHER_CONFIDENCE)).drop("first", "before", "option_value")


def _first(value: str, where: Column) -> Column:
    """(value, source, confidence) of the first record for which ``where`` holds; null if there is none."""
    return F.min_by(F.when(where, F.struct(F.col(value).alias("value"), "source", "confidence")), F.when(where, F.col("order")))


def _last(value: str, where: Column) -> Column:
    return F.max_by(F.when(where, F.col(value)), F.when(where, F.col("order")))


def resolved_variants(rows: DataFrame) -> DataFrame:
    """One row a variant of (product, position, source, sku, title, price, currency, available, stock, options, barcode, weight, image_url).

    Records of one stock code are one variant, those without one by their title,
    those with neither each by itself.  The record of the most trusted source, the
    first by ``position`` (unique in a product) among equals, is the base; the
    others fill what it lacks, in order, and add options it doesn't have.  A base
    that says "not available" gives way to the next known source that says
    anything.  Weights and images of known sources replace the base's, and differ
    from it in ``conflicts``.  The inventory's last record of a stock code has the
    last word on availability and stock.  Empty texts, zeros, prices that aren't
    numbers and nulls are nothing; a null availability of the base is a yes.

    Columns beside the values: ``sources`` and ``confidence`` by field (those that
    some record gave), and ``conflicts`` (field, old_value, new_value, new_source).
    """
    r = records(rows)
    known, base, later = F.col("priority") > 0, F.col("base"), ~F.col("base")
    stocked = later & F.col("source").isin(*STOCK_SOURCES) & F.col("stock").isNotNull()
    inventory = F.col("source") == INVENTORY
    full = lambda c: F.col(c) != (0.0 if c in NUMBERS else "")
    kept = {c: _first(c, full(c)) for c in ("sku", "title", "price", "currency", "barcode")}
    replaced = {c: (_first(c, base & full(c)), _first(c, later & known & full(c)), _first(c, later & full(c))) for c in ("weight", "image_url")}
    g = r.groupBy("product", "key").agg(
        *(x.alias(c) for c, x in kept.items()), *(x.alias(f"{c}_{k}") for c, xs in replaced.items() for k, x in zip(("base", "known", "any"), xs, strict=True)),
        F.min_by(F.struct("available", "source", "confidence"), "order").alias("own"), _first("available", later & known & ~inventory & F.col("available").isNotNull()).alias("next"), F.bool_or(inventory).alias("stocked"),
        _last("available", inventory & F.col("available").isNotNull() & later).alias("told"), F.max_by(F.when(inventory, F.struct("available", "stock")), F.when(inventory, F.col("order"))).alias("last"),
        _last("stock", stocked).alias("later_stock"), F.max_by(F.when(base, F.col("stock")), F.when(base, F.col("order"))).alias("base_stock"),
        F.first("options").alias("options"), F.min_by(F.when(base & F.col("option").isNotNull(), F.struct(F.lit(True).alias("value"), "source", "confidence")), "order").alias("option_source"),
    )

    coded = F.col("key").startswith("sku:")
    yes = F.coalesce(F.col("own.available"), F.lit(True))
    says = F.struct(yes.alias("value"), F.col("own.source").alias("source"), F.col("own.confidence").alias("confidence"))
    at_stock = lambda value: F.struct(value.alias("value"), F.lit(INVENTORY).alias("source"), F.lit(SOURCE_CONFIDENCE[INVENTORY]).alias("confidence"))
    merged = F.when(F.col("told").isNotNull(), at_stock(F.col("told"))).when(~yes & F.col("next").isNotNull(), F.col("next")).otherwise(says)
    available = F.when(coded & F.col("stocked"), at_stock(F.coalesce("last.available", merged["value"]))).otherwise(merged)
    source_known = available["value"] | F.col("told").isNotNull() | (~yes & F.col("next").isNotNull()) | (coded & F.col("stocked"))
    pick = {c: F.coalesce(f"{c}_known", f"{c}_base", f"{c}_any") for c in replaced}
    given = {c: F.when(F.col(f"{c}_known").isNotNull() | F.col(f"{c}_base").isNull(), pick[c]) for c in replaced}  # the base's own has no source
    g = g.select(
        "*", available.alias("available"), F.when(source_known, available).alias("given_available"), *(x.alias(f"picked_{c}") for c, x in pick.items()), *(x.alias(f"given_{c}") for c, x in given.items()),
        F.coalesce(F.when(coded, F.col("last.stock")), F.col("later_stock"), F.col("base_stock")).alias("stock"),
    )
    fields = {c: F.col(c) for c in kept} | {"options": F.col("option_source"), "available": F.col("given_available")} | {c: F.col(f"given_{c}") for c in replaced}
    entries = lambda part: F.map_from_entries(F.filter(F.array(*(F.when(x.isNotNull(), F.struct(F.lit(c).alias("field"), x[part].alias(part))) for c, x in fields.items())), lambda e: e.isNotNull()))
    differs = [F.when(F.col(f"{c}_known.value") != F.col(f"{c}_base.value"), F.struct(F.lit(c).alias("field"), F.col(f"{c}_base.value").cast("string").alias("old_value"), F.col(f"{c}_known.value").cast("string").alias("new_value"), F.col(f"{c}_known.source").alias("new_source"))) for c in replaced]
    empty = lambda c: F.coalesce(F.col(f"{c}.value"), F.lit(0.0 if c in NUMBERS else ""))
    return g.select(
        "product", "key", *(empty(c).alias(c) for c in kept), F.coalesce("picked_weight.value", F.lit(0.0)).alias("weight"), F.coalesce("picked_image_url.value", F.lit("")).alias("image_url"), F.col("available.value").alias("available"), "stock",
        "options", entries("source").alias("sources"), entries("confidence").alias("confidence"), F.filter(F.array(*differs), lambda x: x.isNotNull()).alias("conflicts"),
    )


def confidence_summary(variants: DataFrame) -> DataFrame:
    """(product, avg_confidence, low_confidence, total_conflicts) of resolved variants; ``low_confidence`` counts those with a field below LOW_CONFIDENCE."""
    values = F.map_values("confidence")
    some = variants.select("product", F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("sum"), F.size("confidence").alias("n"), F.exists(values, lambda x: x < LOW_CONFIDENCE).alias("low"), F.size("conflicts").alias("conflicts"))
    return some.groupBy("product").agg(F.round(F.coalesce(F.try_divide(F.sum("sum"), F.sum("n")), F.lit(0.0)), 3).alias("avg_confidence"), F.count_if("low").alias("low_confidence"), F.sum("conflicts").alias("total_conflicts"))
