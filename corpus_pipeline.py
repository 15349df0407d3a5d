"""The corpus pipeline: the operators, one after the other, over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.common import materialise
from lakeloom.llm.stages import dedup_stage, mixing_stage, packing_stage, quality_stage, rules_stage

STAGES = [
    ("quality_classifier", quality_stage),
    ("quality_rules", rules_stage),
    ("ngram_jaccard_join", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Training, tokenising and packing have no SQL form; the tests hold the rows against other versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
