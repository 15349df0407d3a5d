"""Helpers shared by the corpus operators: shared storage, sizes, folds, bytes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest side that is broadcast: a count is taken first, and beyond it the join shuffles.
BROADCAST_BYTES = 48_000_000

#: ASCII bytes that separate words: space, tab, newline, vertical tab, form feed, carriage return.
SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` where the cluster names one; only where that
    is unset and the master is local a temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lakeloom/{name}-{uuid.uuid4().hex}"


_PATHS: list[tuple[SparkSession, str]] = []


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage is cut.

    The table lives until ``remove_tables`` is called or the program ends.
    """
    path = scratch(df.sparkSession, name)
    if not _PATHS:
        atexit.register(remove_tables)
    _PATHS.append((df.sparkSession, path))
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables() -> None:
    """Delete the tables that ``materialise`` wrote in this program; what is read from them ends with them."""
    while _PATHS:
        spark, path = _PATHS.pop()
        with contextlib.suppress(Exception):  # the session may have ended; its folder is left then
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def bounded(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (numbers and short names) with a broadcast hint if a count proves it small, else ``df``.

    A column counts as 16 bytes and a row as 16 more, a text column as 64.
    """
    rows = max_bytes // (16 + sum(64 if f.dataType.typeName() == "string" else 16 for f in df.schema.fields))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_few(rows: DataFrame, few: DataFrame, on: list[str], copies: int, spread: str = "doc_id") -> DataFrame:
    """Left join of ``rows`` with ``few``, which has one row for each key that is in more than ``copies`` of them.

    ``few`` is broadcast if a count proves it small; otherwise both sides are
    salted ``copies`` ways by the column ``spread``, so ``few`` grows to at most
    as many rows as ``rows`` has and no key stays whole.
    """
    few = materialise(few, "few")
    hinted = bounded(few)
    if hinted is not few:
        return rows.join(hinted, on, "left")
    salt = F.pmod(F.xxhash64(spread), F.lit(copies))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long")))
    return rows.withColumn("salt", salt).join(few.withColumn("salt", salts), [*on, "salt"], "left").drop("salt")


#: Rows of one Arrow batch on its way to Python and back: texts are long, and a batch is held several times over.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batch size to BATCH_ROWS unless it is smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back_memory() -> None:
    """Return free heap to the system: Python workers are reused, and an executor's heaps add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run, tokenises: bool = False):
    """A batch function that gives memory back when its task ends.

    A worker that tokenised before and now runs another operator drops its
    tokeniser and the words it remembers first.
    """

    def wrapped(batches):
        tokens = sys.modules.get("lakeloom.llm.tokens")
        if tokens and not tokenises and tokens.tokenizer.cache_info().currsize:
            tokens.tokenizer.cache_clear()
            give_back_memory()
        yield from run(batches)
        give_back_memory()

    return wrapped


def map_texts(df: DataFrame, run, schema, tokenises: bool = False) -> DataFrame:
    """mapInArrow for functions over texts: small batches, and memory given back."""
    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(run, tokenises), schema)


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in no fold (null)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled rows, those whose hashed id is smallest.

    The sample is drawn from (doc_id, label) alone and its bound is proven by
    the limit, so it is broadcast to the texts and no text is shuffled.
    """
    known = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("labelled_id"), "label")
    known = known.orderBy(F.xxhash64(F.col("labelled_id").cast("string"), F.lit(seed)), "labelled_id", "label").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(known), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "label")


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column as one array, and each row's bounds; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a block of texts, and the first word of each text (and the total)."""
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(bounds), dtype=np.int64)
    inside = ~SPACE_BYTES[data]
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False  # a text never continues the last one's word
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = bounds[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


#: An odd multiplier and its inverse modulo 2**64, for prefix hashes.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[:1] = 1
    done, step = min(1, n), base
    while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        step = step * step & ((1 << 64) - 1)
        done += more
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 22) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes give equal hashes.  Spans are in order.

    Within a piece of the block, prefix sums of code(byte) * base**i make every
    span's polynomial hash one subtraction and one multiplication.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    done = 0
    while done < len(starts):
        base = int(starts[done])
        upto = max(int(np.searchsorted(ends, base + piece, side="right")), done + 1)
        stop = int(ends[upto - 1])
        n = stop - base
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODES[data[base:stop]] * _powers(_BASE, n), out=sums[1:])
            s, e = starts[done:upto] - base, ends[done:upto] - base
            out[done:upto] = mix64((sums[e] - sums[s]) * _powers(_INVERSE, n + 1)[s] + (e - s).astype(np.uint64))
        done = upto
    return out


#: Maps A-Z to a-z and leaves every other byte.
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32


def shingle_hashes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the ``width``-word shingles of each text, sorted, and each text's bounds.

    A-Z are lower-cased.  A text with fewer words gives its whole sequence as
    one shingle; a text without words gives none.
    """
    data, bounds = string_bytes(column)
    data = LOWER_BYTES[data]
    starts, ends, first = word_spans(data, bounds)
    words = span_hashes(data, starts, ends)
    counts = np.diff(first)
    with np.errstate(over="ignore"):
        full = np.maximum(counts - width + 1, 0)
        doc = np.repeat(np.arange(len(counts)), full)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(first[:-1], full)
        code = np.zeros(len(at), dtype=np.uint64)
        for k in range(width):
            code = mix64(code * np.uint64(_BASE) + words[at + k] + np.uint64(k + 1))
        short = np.flatnonzero((counts > 0) & (counts < width))
        extra = np.zeros(len(short), dtype=np.uint64)
        for i, d in enumerate(short):
            h = np.zeros(1, dtype=np.uint64)
            for k in range(int(counts[d])):
                h = mix64(h * np.uint64(_BASE) + words[first[d] + k : first[d] + k + 1] + np.uint64(k + 1))
            extra[i] = mix64(h + np.uint64(int(counts[d]) * 7919))[0]
    doc, code = np.concatenate([doc, short]), np.concatenate([code, extra])
    out, sizes = [], np.zeros(len(counts), dtype=np.int64)
    edges = np.concatenate([[0], np.cumsum(full)])
    of_short = dict(zip(short.tolist(), range(len(short)), strict=True))
    for d in range(len(counts)):
        if d in of_short:
            s = extra[of_short[d] : of_short[d] + 1]
        else:
            s = np.unique(code[edges[d] : edges[d + 1]])
        out.append(s)
        sizes[d] = len(s)
    flat = np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])
