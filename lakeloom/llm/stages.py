"""The pipeline's stages: each takes (spark, docs, sf_dir) and applies one operator to docs.

Defined results, for each stage: an empty table gives no rows; columns beside
doc_id, text, lang and source, whatever their names, are not read, and all
stages but the last pass every column on as it is; repeated rows are judged
alike.  What a null means is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import bounded

#: Shares of tokens by domain that the mixing operator aims at: languages, and text of low quality.
TARGETS = {"en": 0.50, "fr": 0.16, "de": 0.16, "es": 0.16, "junk": 0.02}


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label): the domain of each labelled document that has a language."""
    known = labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("labelled_id"), "quality")
    own = docs.where("lang IS NOT NULL").select("doc_id", "lang")
    return own.join(known, F.col("doc_id") == F.col("labelled_id")).select("doc_id", F.when(F.col("quality") == 0, "junk").otherwise(F.col("lang")).alias("label"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword classifier takes for good ones.

    A null or empty text scores as the share of good labels; a null id is scored.
    """
    from lakeloom.llm.queries import quality_model, table
    from lakeloom.llm.subword_classifier import keep_scored

    return keep_scored(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does.

    A null or empty text goes; rows with a null source are judged as one host.
    """
    from lakeloom.llm.quality_rules import keep_passing

    return keep_passing(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near copies (five-word shingles, 0.8).

    Texts without words link with nothing and stay; rows with a null id link
    with nothing and stay; of rows that repeat an id one stays, the one with the
    largest text.
    """
    from lakeloom.llm.jaccard_join import Config, jaccard_components

    found = jaccard_components(docs, Config(width=5, percent=80))
    others = found.where("component_id <> doc_id").select(F.col("doc_id").alias("other"))
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("other"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    kept = rows.join(bounded(others), F.col("id") == F.col("other"), "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    again = bounded(again)
    once = kept.join(again, F.col("id") == F.col("other"), "left_anti")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("row.text").desc_nulls_last()))
    some = kept.join(again, F.col("id") == F.col("other"), "left_semi").withColumn("place", place).where("place = 1")
    return once.select("row.*").unionByName(some.select("row.*"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that bring the domains' tokens to TARGETS.

    A null or empty text has no tokens and the labels' shares as its posterior;
    a null language isn't learned from; a null id is rated like any other.
    """
    from lakeloom.llm.mixing import resample
    from lakeloom.llm.queries import table

    return resample(docs, domain_labels(docs, table(spark, sf_dir, "labels")), TARGETS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into training sequences; other columns end here.

    A null or empty text is a document of the end token; a null id stays null.
    """
    from lakeloom.llm.packing import pack_documents

    return pack_documents(docs)
