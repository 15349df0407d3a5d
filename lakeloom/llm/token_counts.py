"""Token counts of documents in flat token files, found by their end tokens.

``write_token_files`` lays documents down as the files a tokeniser job leaves:
one file of fixed-width ids per task, each document followed by the end token,
no index.  ``separator_scan`` reads such files in blocks of equal size, finds
all end tokens of a block with one vectorised comparison, and stitches the
documents that cross a block's border with a prefix scan over the blocks' last
end tokens and counts.  Files are opened by URI, so any store that pyarrow
knows will do.

Defined results: an empty or null text is a document of no tokens; tokens after
a file's last end token are one document with ``terminated`` false; an empty
file or folder gives no rows; a file that isn't whole ids is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import map_texts, materialise
from lakeloom.llm.tokens import default_tokenizer, encode_with_end

END_ID = 49407
DTYPE = "<u2"
BLOCK_TOKENS = 1 << 20


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = END_ID, dtype: str = DTYPE) -> DataFrame:
    """Write one flat file per task; the rows (file, ordinal, doc_id) say what was put where.

    A task writes under a name of its own attempt and renames at the end, so a
    repeated task leaves the same file.  The rows must be materialised once.
    """
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = open_store(folder)
        name = f"part-{context.partitionId():06d}.bin"
        draft = f"{base}/.{name}.{context.taskAttemptId()}"
        fs.create_dir(base, recursive=True)
        ordinal = 0
        with fs.open_output_stream(draft) as out:
            for batch in batches:
                for row, ids, bounds in encode_with_end(batch.column(1), path, end_id):
                    if ids.max(initial=0) > np.iinfo(dtype).max:
                        raise ValueError(f"an id doesn't fit {dtype}")
                    out.write(ids.astype(dtype).tobytes())
                    n = len(bounds) - 1
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0).slice(row, n)], names=["file", "ordinal", "doc_id"])
                    ordinal += n
        fs.move(draft, f"{base}/{name}")

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "file string, ordinal long, doc_id long", tokenises=True)


def separator_scan(spark: SparkSession, folder: str, end_id: int = END_ID, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of every document in the folder's ``*.bin`` files.

    ``start`` counts ids from the file's beginning; ``n_tokens`` leaves the end token out.
    """
    width = np.dtype(dtype).itemsize
    fs, base = open_store(folder)
    files = [(f.base_name, f.size) for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.base_name.endswith(".bin") and not f.base_name.startswith(".")]
    if odd := [name for name, size in files if size % width]:
        raise ValueError(f"not whole ids of {width} bytes: {odd[:3]}")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(folder)
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    f.seek(block * block_tokens * width)
                    ids = np.frombuffer(f.read(block_tokens * width), dtype=dtype)
                ends = np.flatnonzero(ids == end_id) + block * block_tokens
                last = int(ends[-1]) if len(ends) else None
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([last], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))], names=["file", "block", "n_ids", "n_ends", "last_end", "ends"])

    blocks = spark.createDataFrame([(n, -(-s // (block_tokens * width))) for n, s in files if s], "file string, n_blocks long").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    found = blocks.repartition("file", "block").mapInArrow(scan, "file string, block long, n_ids long, n_ends long, last_end long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stitched = found.select(
        "file", "block", "ends", "n_ends",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("first_ordinal"),
        (F.coalesce(F.max("last_end").over(before), F.lit(-1)) + 1).alias("carried"),
        F.max("block").over(whole).alias("last_block"),
        F.sum("n_ids").over(whole).alias("file_ids"),
    )
    ended = stitched.select("file", "first_ordinal", "carried", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file", (F.col("first_ordinal") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("carried")).otherwise(F.element_at("ends", F.when(F.col("i") == 0, 1).otherwise(F.col("i"))) + 1).alias("start"), "end", F.lit(True).alias("terminated"),
    )
    start = F.coalesce(F.element_at("ends", F.when(F.col("n_ends") == 0, F.lit(1)).otherwise(F.lit(-1))) + 1, F.col("carried"))
    tail = stitched.where(F.col("block") == F.col("last_block")).withColumn("ends", F.when(F.col("n_ends") > 0, F.col("ends")).otherwise(F.array(F.lit(None).cast("long")))).select(
        "file", (F.col("first_ordinal") + F.col("n_ends")).alias("ordinal"), start.alias("start"), F.col("file_ids").alias("end"), F.lit(False).alias("terminated"),
    ).where(F.col("start") < F.col("end"))
    return ended.unionByName(tail).select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "terminated")


def count_document_tokens(docs: DataFrame, folder: str, **options) -> DataFrame:
    """Token counts of documents, through flat files and back: (doc_id, file, ordinal, start, n_tokens)."""
    placed = materialise(write_token_files(docs, folder, **options), "token-files")
    counted = separator_scan(docs.sparkSession, folder, options.get("end_id", END_ID), options.get("dtype", DTYPE))
    return placed.hint("merge").join(counted, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
