"""Incremental ingest: of each batch only new and changed documents are chunked, embedded and stored.

A batch's output is a set of Parquet folders named by its number, and it sees the
state of earlier numbers alone.  Running a batch again, after a failure or a
restart, therefore writes the same rows to the same place.

    folder/chunks/number=N   chunks of the documents that batch N took
    folder/state/number=N    (source, hash) of those documents
    folder/actions/number=N  (source, action) of all documents of the batch
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from lakeloom.operators.chunking import typed_chunks
from lakeloom.storage import stored

_TERM = re.compile("[a-z0-9]+")

STATE = "source string, hash string, number int"


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def known_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(source, hash, number): the newest version of each source, of batches below ``before`` if it is given."""
    rows = spark.read.schema(STATE).option("basePath", f"{folder}/state").parquet(f"{folder}/state")
    rows = rows if before is None else rows.where(F.col("number") < before)
    return rows.groupBy("source").agg(F.max_by("hash", "number").alias("hash"), F.max("number").alias("number"))


def ingest_batch(batch: DataFrame, number: int, folder: str) -> None:
    """Take one batch of (source, at, text); the newest ``at`` of a source counts, the larger hash if they tie.

    Actions are ``new``, ``changed``, ``unchanged``, and ``error`` for a null
    source, which is not stored.  A null or empty text has no chunks, and a
    source that becomes empty loses those it had.  Versions are compared by hash,
    so only texts that are taken are chunked, and none is stored but as chunks.
    """
    spark = batch.sparkSession
    texts = batch.select("source", "at", F.col("text").cast("string").alias("text")).withColumn("hash", content_hash(F.col("text")))
    versions = texts.groupBy("source", "at", "hash").agg(F.count("*").alias("n"))
    newest = versions.groupBy("source").agg(F.max_by(F.struct("at", "hash", "n"), F.struct("at", "hash")).alias("x")).select("source", "x.*")
    if number == 0:  # nothing came before
        known = spark.createDataFrame([], "known_source string, known_hash string")
    else:
        known = known_state(spark, folder, number).select(F.col("source").alias("known_source"), F.col("hash").alias("known_hash"))
    action = F.when(F.col("source").isNull(), "error").when(F.col("known_hash").isNull(), "new").when(F.col("known_hash") != F.col("hash"), "changed").otherwise("unchanged")
    # Written once: the chunks, state and actions are of the same rows.
    told = stored(newest.join(known, F.col("source") == F.col("known_source"), "left").select("source", "at", "hash", "n", action.alias("action")), "ingest")
    taken = told.where("action IN ('new', 'changed')")
    own = taken.select(F.col("source").alias("taken"), F.col("at").alias("taken_at"), F.col("hash").alias("taken_hash"), "n")
    rows = texts.join(own, (F.col("source") == F.col("taken")) & (F.col("hash") == F.col("taken_hash")) & F.col("at").eqNullSafe(F.col("taken_at"))).select("source", "hash", "text", "n")
    if not taken.where("n > 1").isEmpty():  # repeated rows
        rows = rows.where("n = 1").unionByName(rows.where("n > 1").dropDuplicates(["source", "hash"]))
    chunks = typed_chunks(rows.withColumn("doc_id", F.lit(0)), "source", "hash").drop("doc_id")
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/number={number}")
    put(embedded(chunks), "chunks")
    put(told.select("source", "action"), "actions")
    put(taken.select("source", "hash"), "state")  # last: what is in the state has its chunks


def embedded(chunks: DataFrame) -> DataFrame:
    """The rows with ``vector``: the term counts of ``chunk``, added up by the first two hexadecimal digits of the term's md5."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = lru_cache(maxsize=200_000)(lambda t: hashlib.md5(t.encode()).digest()[0])
        for batch in batches:
            counts = [np.bincount(np.fromiter(map(bucket, _TERM.findall((t or "").lower())), dtype=np.int64), minlength=256) for t in batch.column("chunk").to_pylist()]
            flat = np.concatenate(counts).astype(np.float32) if counts else np.zeros(0, dtype=np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * 256, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*batch.schema.names, "vector"])

    return chunks.mapInArrow(run, StructType([*chunks.schema.fields, StructField("vector", ArrayType(FloatType()))]))


def start_ingest(documents: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Start the ingest of a stream of (source, at, text)."""
    return documents.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, number, folder)).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def current_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of the newest version of every source."""
    chunks = spark.read.option("basePath", f"{folder}/chunks").parquet(f"{folder}/chunks")
    return chunks.join(known_state(spark, folder), ["source", "hash", "number"], "left_semi").drop("number")


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """(source, action, number) of all batches."""
    return spark.read.schema("source string, action string, number int").option("basePath", f"{folder}/actions").parquet(f"{folder}/actions")
