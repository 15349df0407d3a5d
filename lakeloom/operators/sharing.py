"""Documents that share words with questions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Questions of one block, whose words are broadcast.
BLOCK = 2000

_WORD = re.compile("[a-z]+")


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def sharing_counts(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, documents): for each of (id, text) the rows of (text) that have a word of it, if there are any.

    The questions' words go out a bounded block at a time and documents are
    counted where they lie, so that no common word becomes a key and no pair of a
    question and a document becomes a row.  Null texts have no words; questions
    with a null id are left out, and those of one id are one question.
    """
    asked = questions.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    n_blocks, found = max(1, -(-asked.count() // BLOCK)), None
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).collect()  # about BLOCK rows
        ids = sorted({r.id for r in rows})
        number, of = {i: k for k, i in enumerate(ids)}, {}
        for r in rows:
            for w in _words(r.text):
                of.setdefault(w, set()).add(number[r.id])
        held = docs.sparkSession.sparkContext.broadcast((np.array(ids, dtype=np.int64), {w: np.array(sorted(x)) for w, x in of.items()}))

        def count(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, of = held.value
            n = np.zeros(len(ids), dtype=np.int64)
            for batch in batches:
                for text in batch.column(0):
                    if hits := [of[w] for w in _words(text.as_py()) & of.keys()]:
                        n[np.unique(np.concatenate(hits))] += 1
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some])], names=["id", "n"])

        part = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "id long, n long")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("id").agg(F.sum("n").alias("documents"))
