"""Packing documents into training sequences of balanced attention cost.

Documents are tokenised and packed in the task that reads them, a block of
about five hundred sequences at a time, so nothing is shuffled and memory does
not grow with the table.  In a block, pieces longer than a sequence are cut
first; then the documents go, longest first, to the sequence of lowest cost
(linear in its tokens plus quadratic in each piece, as attention is masked at
document borders) that has room.  A document that fits nowhere is cut to fill
the cheapest sequence.  What is over when a block's sequences are full goes on
to the next block; the last tokens of a task fill sequences whose lengths are
powers of two, which are not padded.

Defined results: a null or empty text is a document of the end token alone; a
null id is packed and stays null; repeated rows are packed each on its own; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import map_texts
from lakeloom.llm.tokens import default_tokenizer, encode_with_end

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, attention_cost double"
)


@dataclass
class Piece:
    """Tokens ``start`` to ``start + length`` of a document."""

    doc: int
    start: int
    length: int


def _fill(pieces: list[Piece], n_full: int, capacity: int, linear: float, quadratic: float) -> tuple[list[list[Piece]], list[Piece]]:
    """Fill ``n_full`` sequences to the last token; return them and what is over.

    ``ready`` holds sequences by cost; one that lacks room for the piece at hand
    waits in ``parked``, by room, until a piece comes that it can take.
    """
    sequences: list[list[Piece]] = [[] for _ in range(n_full)]
    room, costs = [capacity] * n_full, [0.0] * n_full
    ready, parked = [(0.0, i) for i in range(n_full)], []
    over: list[Piece] = []
    for piece in sorted(pieces, key=lambda p: -p.length):  # stable: ties keep the order of the input
        while piece.length and (ready or parked):
            while parked and -parked[0][0] >= piece.length:
                i = heapq.heappop(parked)[1]
                heapq.heappush(ready, (costs[i], i))
            while ready and room[ready[0][1]] < piece.length:
                i = heapq.heappop(ready)[1]
                heapq.heappush(parked, (-room[i], i))
            if ready:
                i = heapq.heappop(ready)[1]
            else:  # it fits nowhere: cut to fill the cheapest, which is full then
                i = min((costs[i], i) for _, i in parked)[1]
                parked.remove((-room[i], i))
                heapq.heapify(parked)
            n = min(piece.length, room[i])
            sequences[i].append(Piece(piece.doc, piece.start, n))
            room[i] -= n
            costs[i] += linear * n + quadratic * n * n
            if room[i]:
                heapq.heappush(ready, (costs[i], i))
            piece = Piece(piece.doc, piece.start + n, piece.length - n)
        if piece.length:
            over.append(piece)
    return sequences, over


def pack_block(pieces: list[Piece], capacity: int = 4096, linear: float = 1.0, quadratic: float = 1 / 4096, last: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    """Pack pieces; return the sequences and the pieces that are left for the next block (none if ``last``)."""
    sequences, rest = [], []
    for p in pieces:
        cut = p.length // capacity
        sequences += [[Piece(p.doc, p.start + k * capacity, capacity)] for k in range(cut)]
        if p.length % capacity:
            rest.append(Piece(p.doc, p.start + cut * capacity, p.length % capacity))
    filled, rest = _fill(rest, sum(p.length for p in rest) // capacity, capacity, linear, quadratic)
    sequences += filled
    if last and rest:
        left = sum(p.length for p in rest)
        size = 1 << (left.bit_length() - 1)
        while rest:  # the binary digits of what is left
            filled, rest = _fill(rest, 1, size, linear, quadratic)
            sequences += filled
            left -= size
            size = 1 << (left.bit_length() - 1) if left else 0
    return sequences, rest


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, capacity: int = 4096, linear: float = 1.0, quadratic: float = 1 / 4096, block_sequences: int = 512, special_names: bool = True) -> DataFrame:
    """One row per piece: where it comes from, where it lies, and the crc32 of its ids.

    ``special_names``: the name of a special token in a text is its id, as plain ``tokenizers`` has it.
    """
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # document -> (id, its tokens)
        waiting: list[Piece] = []
        tokens, seen, made = 0, 0, TaskContext.get().partitionId() << 36

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal waiting, tokens, made
            sequences, waiting = pack_block(waiting, capacity, linear, quadratic, last)
            rows: list[tuple] = []
            for s in sequences:
                at, size = 0, sum(p.length for p in s)
                cost = sum(linear * p.length + quadratic * p.length**2 for p in s)
                for p in s:
                    name, ids = held[p.doc]
                    crc = zlib.crc32(ids[p.start : p.start + p.length].astype("<u4").tobytes())
                    rows.append((name, p.start, p.length, crc, len(ids), made, at, size, cost))
                    at += p.length
                made += 1
            keep = {p.doc for p in waiting}
            for d in [d for d in held if d not in keep]:
                del held[d]
            for p in waiting:  # a copy, so that the batch it was cut from can go
                held[p.doc] = (held[p.doc][0], held[p.doc][1].copy())
            tokens = sum(p.length for p in waiting)
            kinds = [pa.int64()] * 8 + [pa.float64()]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            columns = zip(*rows, strict=True) if rows else [[]] * 9
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            names = batch.column(0)
            for row, ids, bounds in encode_with_end(batch.column(1), path, end_id, special_names):
                for i in range(len(bounds) - 1):
                    held[seen] = (names[row + i].as_py(), ids[bounds[i] : bounds[i + 1]])
                    waiting.append(Piece(seen, 0, int(bounds[i + 1] - bounds[i])))
                    tokens += waiting[-1].length
                    seen += 1
                    if tokens >= capacity * block_sequences:
                        yield flush(False)
        if waiting:
            yield flush(True)

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA, tokenises=True)
