"""Evaluation of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import vocabulary as V
from lakeloom.operators.evaluate import gate, ranking_quality
from lakeloom.operators.vector import cosine_top_k
from lakeloom.plans.registry import query, table
from lakeloom.plans.retrieval import PAIRS_SQL, vectors

QUALITY_SQL = f"""{PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p), x AS (SELECT query_id, count(*) FILTER (WHERE label = q_label) AS n_expected FROM p GROUP BY 1),
h AS (SELECT query_id, count(*) FILTER (WHERE label = q_label) AS hits, min(rank) FILTER (WHERE label = q_label) AS first FROM r WHERE rank <= 10 GROUP BY 1),
m AS (SELECT query_id, hits / 10 AS p, CASE WHEN n_expected = 0 THEN 1.0 ELSE hits / n_expected END AS r, first FROM x JOIN h USING (query_id)),
q AS (SELECT query_id, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 4) AS f1, round(coalesce(1.0 / first, 0.0), 4) AS reciprocal_rank FROM m)"""


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, rows = vectors(spark, sf_dir)
    own, other = asked.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")), rows.select("id", "label")
    sizes = rows.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("n_expected"))
    ranked = cosine_top_k(asked, rows, 10).join(own, "query_id").join(other, "id")
    return ranking_quality(ranked, F.col("label") == F.col("wanted"), own.join(sizes, "wanted").select("query_id", "n_expected"), 10)


@query(f"WITH {QUALITY_SQL} SELECT query_id, CAST(precision AS DOUBLE) AS precision, CAST(recall AS DOUBLE) AS recall, CAST(f1 AS DOUBLE) AS f1, CAST(reciprocal_rank AS DOUBLE) AS reciprocal_rank FROM q")
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and reciprocal rank of every query, rows of its label being relevant."""
    return quality(spark, sf_dir)


@query(f"""WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p WHERE similarity >= 0.35), a AS (SELECT DISTINCT query_id FROM p),
t AS (SELECT query_id, count(id) AS n, coalesce(max(CASE WHEN label = q_label THEN 1 ELSE 0 END), 0) AS hit, coalesce(max(similarity), 0.0) AS top FROM a LEFT JOIN (SELECT * FROM r WHERE rank <= 5) x USING (query_id) GROUP BY 1),
g AS (SELECT count(*) AS queries, round(avg(hit), 4) AS recall_at_k, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 4) AS no_result_rate, round(avg(top), 4) AS avg_top_similarity FROM t),
v AS (SELECT *, list_filter([CASE WHEN recall_at_k < 0.7 THEN 'recall_at_k' END, CASE WHEN no_result_rate > 0.1 THEN 'no_result_rate' END, CASE WHEN avg_top_similarity < 0.4 THEN 'avg_top_similarity' END], lambda x: x IS NOT NULL) AS violations FROM g) SELECT *, len(violations) = 0 AS passed FROM v""")
def retrieval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over all queries: found among five hits above the threshold, no hits at all, similarity of the first."""
    asked, rows = vectors(spark, sf_dir)
    own, other = asked.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")), rows.select("id", "label")
    hits = cosine_top_k(asked, rows, 5, threshold=V.SIMILARITY_THRESHOLD).join(other, "id")
    told = own.join(hits, "query_id", "left").groupBy("query_id").agg(F.count("id").alias("n"), F.max((F.col("label") == F.col("wanted")).cast("int")).alias("hit"), F.max("similarity").alias("top"))
    return gate(told, {"recall_at_k": V.RECALL_FROM, "no_result_rate": V.NO_RESULT_TO, "avg_top_similarity": V.SIMILARITY_FROM})


@query("""SELECT event_type AS path, count(*) AS n, count(*) FILTER (WHERE value <= CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 500 ELSE 3000 END) AS met,
round(count(*) FILTER (WHERE value <= CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 500 ELSE 3000 END) / count(*), 4) AS rate FROM events GROUP BY 1""")
def service_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests within the limit of their path."""
    limit = F.when(F.col("event_type") == "view", V.SLA_MS["cached"]).when(F.col("event_type") == "click", V.SLA_MS["fast"]).otherwise(V.SLA_MS["full"])
    met = F.count_if(F.col("value") <= limit)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("path")).agg(F.count("*").alias("n"), met.alias("met"), F.round(met / F.count("*"), 4).alias("rate"))


@query("""SELECT user_id, count(*) AS failures, count(*) FILTER (WHERE value = 0) AS empty, round(min(value), 2) AS lowest FROM events WHERE value < 25 GROUP BY 1""")
def failed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed searches by tenant."""
    return table(spark, sf_dir, "events").where("value < 25").groupBy("user_id").agg(F.count("*").alias("failures"), F.count_if(F.col("value") == 0).alias("empty"), F.round(F.min("value"), 2).alias("lowest"))


@query("""SELECT quality, toxic, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels), 4) AS share FROM labels GROUP BY 1, 2""")
def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels' cross table."""
    labels = table(spark, sf_dir, "labels")
    total = labels.agg(F.count("*").alias("all"))
    return labels.groupBy("quality", "toxic").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("quality", "toxic", "n", F.round(F.col("n") / F.col("all"), 4).alias("share"))  # one row
