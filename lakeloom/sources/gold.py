"""Gold queries from JSON, with the platforms that they are for and how critical fields are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERY = (
    "query_id string, category string, platform_tags array<string>, query string, expected_urls array<string>, expected_skus array<string>, "
    "expected_prices map<string,double>, expected_fields map<string,array<string>>, min_completeness double, notes string"
)
_FILE = f"queries array<struct<{_QUERY.replace(' string', ':string').replace(' array', ':array').replace(' map', ':map').replace(' double', ':double')}>>, field_criticality map<string,string>, platform_coverage map<string,array<string>>"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_FILE).json(path, multiLine=True)


def gold_queries(spark: SparkSession, path: str, platform: str | None = None, category: str | None = None) -> DataFrame:
    """The queries of JSON files of {queries, platform_coverage} or of flat lists, those of a platform and category if given.

    A platform's queries are those that the file's ``platform_coverage`` lists; a
    file without any coverage has no platforms, and all its queries stay.  What a
    query doesn't have is an empty text, list or map; addresses lose the slashes
    at their end.
    """
    files = _whole(spark, path).where("queries IS NOT NULL").select(F.explode("queries").alias("q"), "platform_coverage").select("q.*", "platform_coverage")
    flat = spark.read.schema(_QUERY).json(path, multiLine=True).where("query_id IS NOT NULL").withColumn("platform_coverage", F.lit(None).cast("map<string,array<string>>"))
    rows = files.unionByName(flat)
    if platform is not None:
        listed = F.coalesce(F.array_contains(F.element_at("platform_coverage", F.lit(platform)), F.coalesce("query_id", F.lit(""))), F.lit(False))
        rows = rows.where(F.col("platform_coverage").isNull() | (F.size("platform_coverage") == 0) | listed)
    if category is not None:
        rows = rows.where(F.coalesce("category", F.lit("")) == category)
    text, many = lambda c: F.coalesce(c, F.lit("")).alias(c), lambda c, kind: F.coalesce(c, F.array().cast(kind) if kind.startswith("array") else F.create_map().cast(kind)).alias(c)
    urls = F.transform(F.coalesce("expected_urls", F.array().cast("array<string>")), lambda u: F.regexp_replace(u, "/+$", ""))
    return rows.select(text("query_id"), text("category"), many("platform_tags", "array<string>"), text("query"), urls.alias("expected_urls"), many("expected_skus", "array<string>"), many("expected_prices", "map<string,double>"), many("expected_fields", "map<string,array<string>>"), "min_completeness", text("notes"))


def field_criticality(spark: SparkSession, path: str) -> DataFrame:
    """(field, criticality) of the files that say it."""
    return _whole(spark, path).where("field_criticality IS NOT NULL").select(F.explode("field_criticality").alias("field", "criticality"))
