"""Short or fragmentary chunks with the chunks around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is short, and what is always expanded.
SHORT = 200
ALWAYS = ("table", "faq", "documentation")


def needs_context(content: Column, kind: Column) -> Column:
    return (F.length(F.coalesce(content, F.lit(""))) < SHORT) | F.coalesce(kind, F.lit("text")).isin(*ALWAYS)


def expanded_chunks(chunks: DataFrame, window: int = 1, force: bool = False) -> DataFrame:
    """(id, content, expanded) of (id, source, chunk_index, kind, content).

    A chunk that is short or of a kind in ALWAYS, or any with ``force``, becomes
    the chunks of its source at most ``window`` places from it, in order, joined
    by blank lines, if that is longer than itself.  Chunks without a source or
    place stay as they are; null contents are empty; chunks of one place follow in
    the order of their ids.  Neighbours are found by place, so that no source is
    gathered: a key has the chunks of one place and those that ask for it.
    """
    rows = chunks.select("id", F.coalesce("source", F.lit("")).alias("source"), "chunk_index", F.coalesce("content", F.lit("")).alias("content"), (F.lit(force) | needs_context(F.col("content"), F.col("kind"))).alias("asks"))
    asking = rows.where("asks AND source <> '' AND chunk_index IS NOT NULL")
    wanted = asking.select(F.col("id").alias("asker"), "source", F.explode(F.sequence(F.greatest(F.lit(0), F.col("chunk_index") - window), F.col("chunk_index") + window)).alias("chunk_index"))
    found = wanted.join(rows.select("source", "chunk_index", "id", "content"), ["source", "chunk_index"])
    whole = found.groupBy("asker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "content"))), lambda x: x["content"]), "\n\n").alias("whole"))
    told = rows.join(whole, F.col("id") == F.col("asker"), "left")
    longer = F.coalesce(F.length("whole") > F.length("content"), F.lit(False))
    return told.select("id", F.when(longer, F.col("whole")).otherwise(F.col("content")).alias("content"), longer.alias("expanded"))
