"""Retrieval quality: recall, precision, reciprocal rank and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_quality(ranked: DataFrame, relevant: Column, expected: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, f1, reciprocal_rank) of (query_id, rank, ...) rows.

    ``expected`` holds (query_id, n_expected): recall is 1 where nothing is
    expected.  Precision divides by k.
    """
    hits = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.count_if(relevant).alias("hits"), F.min(F.when(relevant, F.col("rank"))).alias("first"))
    joined = expected.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    precision = F.col("hits") / k
    recall = F.when(F.col("n_expected") == 0, 1.0).otherwise(F.col("hits") / F.col("n_expected"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return joined.select("query_id", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4).alias("reciprocal_rank"))


def response_quality(had_context: Column, hallucinated: Column, length: Column, n_retrieved: Column) -> Column:
    """1 less penalties for a missing context, a hallucination, a very short answer and nothing retrieved; 0 at least."""
    penalty = F.when(had_context, 0.0).otherwise(0.4) + F.when(hallucinated, 0.5).otherwise(0.0) + F.when(length < 50, 0.2).otherwise(0.0) + F.when(n_retrieved == 0, 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.round(1.0 - penalty, 2))


def gate(told: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row of (query, n results, hit, top similarity) rows: the three measures, those that break their limit, and whether none does."""
    c = F.col
    mean = lambda x: F.round(F.avg(x.cast("double")), 4)
    means = told.agg(F.count("*").alias("queries"), mean(F.coalesce("hit", F.lit(0))).alias("recall_at_k"), mean((c("n") == 0).cast("int")).alias("no_result_rate"), mean(F.coalesce("top", F.lit(0.0))).alias("avg_top_similarity"))
    broken = [F.when(c("no_result_rate") > limits["no_result_rate"] if k == "no_result_rate" else c(k) < v, k) for k, v in limits.items()]
    return means.withColumn("violations", F.filter(F.array(*broken), lambda x: x.isNotNull())).withColumn("passed", F.size("violations") == 0)


def mean_scores(scores: DataFrame, by: str, dimensions: list[str], low: float = 5.0) -> DataFrame:
    """Per group the rows, the mean of every dimension, the mean over all of them, and how many rows are below ``low``."""
    overall = sum((F.col(d) for d in dimensions[1:]), F.col(dimensions[0])) / len(dimensions)
    means = [F.round(F.avg(d), 4).alias(f"mean_{d}") for d in dimensions]
    return scores.groupBy(by).agg(F.count("*").alias("n"), *means, F.round(F.avg(overall), 4).alias("mean_overall"), F.count_if(F.round(overall, 2) < low).alias("low_quality"))
