"""Merging what several sources say of one entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fuse_fields(facts: DataFrame, entity: str, field: str, value: str, priority: str, order: list[str]) -> DataFrame:
    """(entity, field, value, priority, conflicts): per field the value of highest priority, the earliest by ``order`` among equals.

    Null and empty values don't count.  ``conflicts`` is the number of other
    values.  The winner is a minimum over structs, so facts are reduced before
    they are shuffled.
    """
    known = facts.where(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
    best = F.min(F.struct((-F.col(priority)).alias("p"), *order, F.col(value).alias("v"))).alias("b")
    return known.groupBy(entity, field).agg(best, (F.countDistinct(value) - 1).alias("conflicts")).select(entity, field, F.col("b.v").alias(value), (-F.col("b.p")).alias(priority), "conflicts")


def fuse_variants(variants: DataFrame, keys: list[str], priority: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row per variant: the last of highest priority wins, as a later source overwrites an equal one."""
    best = F.max(F.struct(priority, *order, *columns)).alias("b")
    return variants.groupBy(*keys).agg(best).select(*keys, F.col(f"b.{priority}").alias(priority), *[F.col(f"b.{c}").alias(c) for c in columns])


def completeness(core: list[Column], sku: Column, variants: Column, attributes: list[Column], logistics: list[Column], description_length: Column, weights: dict[str, float]) -> Column:
    """The weighted completeness of a product record, 0 to 1; the lists hold one boolean a field."""
    mean = lambda flags: sum((f.cast("int") for f in flags), F.lit(0)) / len(flags)
    parts = {"core_fields": mean(core), "sku_coverage": sku, "variant_coverage": variants, "attribute_coverage": mean(attributes), "logistics": mean(logistics), "content_quality": F.least(F.lit(1.0), description_length / 200)}
    return sum((parts[k] * w for k, w in weights.items()), F.lit(0.0))
