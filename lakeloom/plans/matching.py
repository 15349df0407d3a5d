"""Records of two tables that are one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.matching import first_matches
from lakeloom.plans.registry import query, table

_WORDS = "list_distinct(regexp_extract_all(lower(array_to_string({0}, ' ')), '[\\p{{L}}\\p{{N}}_]+'))"


@query(f"""WITH t AS (SELECT doc_id, source, string_split(text, ' ')[1:12] AS w FROM documents), e AS (SELECT doc_id AS id, source || '/' || doc_id AS address, {_WORDS.format("w")} AS words FROM t),
r AS (SELECT 1000000000 - doc_id AS position, source || '/' || (doc_id - doc_id % 2) AS address, {_WORDS.format("list_concat(w[1:4], w[6:12])")} AS words FROM t),
p AS (SELECT id, min(position) AS position FROM e JOIN r ON e.address = r.address OR (len(e.words) > 0 AND len(r.words) > 0 AND len(list_intersect(e.words, r.words)) / len(list_distinct(list_concat(e.words, r.words))) > 0.85) GROUP BY 1)
SELECT e.id, p.position, CASE WHEN p.position IS NOT NULL THEN e.address = r.address END AS by_url FROM e LEFT JOIN p USING (id) LEFT JOIN r USING (position)""")
def matched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's first match among records of all documents: half keep the address, all lose the title's fifth word."""
    docs = table(spark, sf_dir, "documents").withColumn("w", F.slice(F.split("text", " "), 1, 12))
    title = lambda words: F.array_join(words, " ")
    own = docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "doc_id").alias("url"), title("w").alias("title"))
    others = docs.select((F.lit(1000000000) - F.col("doc_id")).alias("position"), F.concat(F.concat_ws("/", "source", F.col("doc_id") - F.col("doc_id") % 2), F.lit("/")).alias("url"), title(F.filter("w", lambda _, i: i != 4)).alias("title"))
    return first_matches(own, others)
