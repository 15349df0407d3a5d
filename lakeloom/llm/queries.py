"""The registered queries of the corpus operators: ``opN_<name>(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.jaccard_join import JOIN_SQL
from lakeloom.llm.merkle import MANIFEST_SQL
from lakeloom.llm.periodic_runs import RUNS_SQL
from lakeloom.llm.quality_rules import JUDGE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard similarity 0.9 of 3-word shingles."""
    from lakeloom.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, rule failures and host-aware verdicts of all documents."""
    from lakeloom.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op6_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every 20th embedding."""
    from lakeloom.llm.nearest_neighbours import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and rates of all documents."""
    from lakeloom.llm.mixing import soft_mix
    from lakeloom.llm.stages import TARGETS, domain_labels

    docs = table(spark, sf_dir, "documents")
    return soft_mix(docs, domain_labels(docs, table(spark, sf_dir, "labels")), TARGETS)


def op8_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    from lakeloom.llm.common import fold
    from lakeloom.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op9_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 4096 tokens."""
    from lakeloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from the flat token files that are written of them."""
    from lakeloom.llm.common import scratch
    from lakeloom.llm.token_counts import count_document_tokens

    return count_document_tokens(table(spark, sf_dir, "documents"), scratch(spark, "op1"))


def quality_model(docs: DataFrame, labels: DataFrame):
    """A classifier of ``labels.quality``, learned from the rows outside fold 1 of 3."""
    from lakeloom.llm.common import fold
    from lakeloom.llm.subword_classifier import train

    known = labels.where(F.col("quality").isNotNull() & (fold("doc_id", 3) != 1)).select("doc_id", F.col("quality").alias("label"))
    return train(docs, known)


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    from lakeloom.llm.common import fold
    from lakeloom.llm.subword_classifier import score

    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences in keyed training order, written as fixed-stride shards."""
    from lakeloom.llm.common import scratch
    from lakeloom.llm.training_order import write_training_order

    return write_training_order(table(spark, sf_dir, "documents"), scratch(spark, "op3"), key=20240101)


def op10_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    from lakeloom.llm.common import fold
    from lakeloom.llm.toxicity import learn, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where(F.col("toxic").isNotNull() & (fold("doc_id", 5) != 0)).select("doc_id", F.col("toxic").alias("label"))
    lexicon = learn(docs, known)
    return score(docs, lexicon).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, a third of them tampered with and climbed again."""
    from lakeloom.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op12_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components at three differing bits."""
    from lakeloom.llm.covering_simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in all documents, and the hashes of the texts without the repeats."""
    from lakeloom.llm.periodic_runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_separator_scan": op1_separator_scan,
    "op2_subword_quality": op2_subword_quality,
    "op3_training_order": op3_training_order,
    "op4_token_group_join": op4_token_group_join,
    "op5_host_rules": op5_host_rules,
    "op6_multiprobe_neighbours": op6_multiprobe_neighbours,
    "op7_soft_mixing": op7_soft_mixing,
    "op8_kneser_ney_language": op8_kneser_ney_language,
    "op9_cost_balanced_packing": op9_cost_balanced_packing,
    "op10_toxic_lexicon": op10_toxic_lexicon,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_covering_simhash": op12_covering_simhash,
    "op13_lyndon_runs": op13_lyndon_runs,
}

ORACLE_SQL: dict[str, str] = {"op4_token_group_join": JOIN_SQL, "op5_host_rules": JUDGE_SQL, "op11_merkle_manifest": MANIFEST_SQL, "op13_lyndon_runs": RUNS_SQL}
