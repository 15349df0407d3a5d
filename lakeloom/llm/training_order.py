"""Training order: every sequence gets a global slot, and slots are written as fixed-stride shards.

1. Each task tokenises its documents, ends each with the end token, joins them
   and cuts sequences of ``seq_len`` ids (the last is filled with the end
   token).  They are staged in the shared folder, with their number per task.
2. A running sum over the tasks' numbers gives every sequence its index in
   0..N-1, and a keyed Feistel network over the next power of four, walked
   along its cycle until it falls below N, turns the index into a slot: a
   permutation that any later run with the key can compute for one index alone.
3. Slots are dealt by range, one range per shard file, with known bounds (a
   permutation has no gaps, so nothing is sampled); each range is sorted and
   written as rows of ``seq_len`` ids.  Slot s lies in shard ``s // rows`` at row
   ``s % rows``, so a reader resumes at any slot with one seek.

Defined results: null and empty texts are end tokens alone; an empty table
writes nothing and gives no rows; repeated rows are sequences of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import map_texts, materialise, mix64
from lakeloom.llm.token_counts import DTYPE, END_ID, open_store
from lakeloom.llm.tokens import default_tokenizer, encode_with_end

STAGED = "part int, local long, n_real int, doc_ids array<long>, ids binary"
PLACED = "slot long, shard long, byte_offset long, index long, n_real int, doc_ids array<long>, ids_crc32 long"


def feistel_slots(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slots in 0..n-1 of indices in 0..n-1: a keyed bijection."""
    half = max(1, -(-(max(n - 1, 1)).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key & ((1 << 64) - 1)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]  # outside: walk on
    return out.astype(np.int64)


def cut_sequences(docs: DataFrame, tokenizer_path: str | None, end_id: int, dtype: str, seq_len: int) -> DataFrame:
    """(part, local, n_real, doc_ids, ids): the sequences of each task's documents, joined end to end."""
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local = TaskContext.get().partitionId(), 0
        rest, names, edges = np.zeros(0, dtype=np.uint32), [], []  # edges: where each name's ids end in rest

        def emit(stream: np.ndarray, names: list, edges: np.ndarray, n: int) -> pa.RecordBatch:
            nonlocal local
            spans = [(int(np.searchsorted(edges, k * seq_len, side="right")), int(np.searchsorted(edges, min((k + 1) * seq_len, edges[-1]), side="left"))) for k in range(n)]
            real = [int(min(seq_len, edges[-1] - k * seq_len)) for k in range(n)]
            rows = [[part] * n, list(range(local, local + n)), real, [names[a : b + 1] for a, b in spans], [stream[k * seq_len : (k + 1) * seq_len].astype(dtype).tobytes() for k in range(n)]]
            local += n
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["part", "local", "n_real", "doc_ids", "ids"])

        for batch in batches:
            for row, ids, bounds in encode_with_end(batch.column(1), path, end_id):
                stream = np.concatenate([rest, ids])
                names = names + batch.column(0).slice(row, len(bounds) - 1).to_pylist()
                edges = np.concatenate([np.asarray(edges, dtype=np.int64), bounds[1:] + len(rest)])
                n = len(stream) // seq_len
                if n:
                    yield emit(stream, names, edges, n)
                done = n * seq_len
                first = int(np.searchsorted(edges, done, side="right"))
                rest, names, edges = stream[done:].copy(), names[first:], edges[first:] - done
        if len(rest):
            yield emit(np.concatenate([rest, np.full(seq_len - len(rest), end_id, dtype=np.uint32)]), names, np.asarray(edges), 1)

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, STAGED, tokenises=True)


def write_training_order(docs: DataFrame, folder: str, key: int = 1, seq_len: int = 2048, shard_rows: int = 4096, tokenizer_path: str | None = None, end_id: int = END_ID, dtype: str = DTYPE) -> DataFrame:
    """Write the shards; one row per sequence says where it lies and what it holds."""
    spark = docs.sparkSession
    staged = materialise(cut_sequences(docs, tokenizer_path, end_id, dtype, seq_len), "sequences", compression="zstd")
    # One number per task of the reading stage: small, and summed here.
    sizes = sorted((r.part, r.n) for r in staged.groupBy("part").agg(F.count("*").alias("n")).collect())
    firsts, total = {}, 0
    for part, n in sizes:
        firsts[part] = total
        total += n
    n_shards = max(1, -(-total // shard_rows))
    stride = seq_len * np.dtype(dtype).itemsize

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            index = np.array([firsts[p] for p in batch.column(0).to_pylist()], dtype=np.int64) + batch.column(1).to_numpy()
            slots = feistel_slots(index, total, key)
            packed = pa.array([press.compress(x) for x in batch.column(4).to_pylist()], pa.binary())  # less to shuffle
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array((slots // shard_rows).astype(np.int32)), pa.array(index), batch.column(2), batch.column(3), packed], names=["slot", "shard", "index", "n_real", "doc_ids", "ids"])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opener, attempt = zstandard.ZstdDecompressor(), TaskContext.get().taskAttemptId()
        fs, base = open_store(folder)
        out, name, draft, at = None, "", "", 0
        for batch in batches:
            crcs = []
            for slot, shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if f"shard-{shard:06d}.bin" != name:
                    if out:
                        out.close()
                        fs.move(draft, f"{base}/{name}")
                    fs.create_dir(base, recursive=True)
                    name = f"shard-{shard:06d}.bin"
                    draft, at = f"{base}/.{name}.{attempt}", 0
                    out = fs.open_output_stream(draft)
                row = opener.decompress(ids)
                if slot % shard_rows != at or len(row) != stride:
                    raise ValueError(f"slot {slot} is out of order")
                out.write(row)
                crcs.append(zlib.crc32(row))
                at += 1
            slots = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(slots // shard_rows), pa.array(slots % shard_rows * stride), batch.column(2), batch.column(3), batch.column(4), pa.array(crcs, pa.int64())], names=[f.split()[0] for f in PLACED.split(", ")])
        if out:
            out.close()
            fs.move(draft, f"{base}/{name}")

    placed = staged.mapInArrow(place, "slot long, shard int, index long, n_real int, doc_ids array<long>, ids binary")
    dealt = placed.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("slot")
    return materialise(dealt.mapInArrow(write, PLACED), "shards")


def read_sequences(folder: str, start_slot: int, count: int, seq_len: int = 2048, shard_rows: int = 4096, dtype: str = DTYPE) -> Iterator[np.ndarray]:
    """The ids of slots ``start_slot`` onward, read in order; a reader resumes with the next slot's number."""
    fs, base = open_store(folder)
    stride, slot, stop = seq_len * np.dtype(dtype).itemsize, start_slot, start_slot + count
    while slot < stop:
        shard, row = divmod(slot, shard_rows)
        path = f"{base}/shard-{shard:06d}.bin"
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return
        with fs.open_input_file(path) as f:
            f.seek(row * stride)
            for _ in range(min(stop, (shard + 1) * shard_rows) - slot):
                data = f.read(stride)
                if len(data) < stride:
                    return
                yield np.frombuffer(data, dtype=dtype)
                slot += 1
