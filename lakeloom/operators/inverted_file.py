"""An inverted-file index over embeddings: k-means cells, of which a search opens the nearest.

Cells are fitted on all rows by rounds of distributed sums, so only ``lists``
vectors meet the driver.  The index is a table of rows with their cell; a search
sends each query to its nearest cells, where parts of bounded size are compared
and only the best of each part go on.  With all cells probed a search is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.storage import stored

#: Numbers of the vectors of one part (rows or queries) that are compared in one task: 32 MB.
PART_NUMBERS = 1 << 22


@dataclass(frozen=True)
class Index:
    """``rows`` (list, part, id, vector), stored; ``cells``, unit vectors; ``parts`` of each list."""

    rows: DataFrame
    cells: np.ndarray
    parts: dict[int, int]


def _sound(rows: DataFrame) -> DataFrame:
    """(id, vector) of the rows whose vectors have numbers alone, and as many as most."""
    v = F.col("vector")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), v.cast("array<double>").alias("vector"))


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def _sums(rows: DataFrame, cells: np.ndarray) -> np.ndarray:
    """The next cells: unit sums of the rows nearest to each; a cell without rows stays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros_like(cells)
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column(0))
                np.add.at(sums, np.argmax(x @ cells.T, axis=1), x)
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        at = np.repeat(used, cells.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(np.arange(cells.shape[1]), len(used))), pa.array(sums[used].ravel())], names=["list", "at", "x"])

    out = np.zeros_like(cells)
    for r in rows.select("vector").mapInArrow(run, "list long, at long, x double").groupBy("list", "at").agg(F.sum("x").alias("x")).toLocalIterator():  # lists x dimensions
        out[r["list"], r["at"]] = r["x"]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    # Rounded, as the order of sums may differ from run to run.
    return np.where(size == 0, cells, np.round(out / np.where(size == 0, 1, size), 9))


def _nearest(rows: DataFrame, cells: np.ndarray, n: int) -> DataFrame:
    """(list, id, vector): each row in its ``n`` nearest lists; ties to smaller lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.argsort(-np.round(_unit(batch.column(1)) @ cells.T, 9), axis=1, kind="stable")[:, :n]
                take = pa.array(np.repeat(np.arange(batch.num_rows), found.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), batch.column(0).take(take), batch.column(1).take(take)], names=["list", "id", "vector"])

    return rows.mapInArrow(run, "list long, id long, vector array<double>")


def build(rows: DataFrame, lists: int = 100, rounds: int = 8) -> Index:
    """An index of (id, vector).  The first cells are the ``lists`` rows of smallest hashed id.

    Vectors that are null, empty, hold a null or non-finite number, or have
    another length than most, and rows with a null id, are not indexed.  A zero
    vector lies in the first list.
    """
    sound = _sound(rows)
    most = sound.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = most.dim if most else 1
    sound = sound.where(F.size("vector") == dim)
    first = [r.vector for r in sound.orderBy(F.xxhash64("id"), "id").limit(lists).collect()]
    cells = np.array(first, dtype=np.float64).reshape(-1, dim)
    size = np.linalg.norm(cells, axis=1, keepdims=True)
    cells = cells / np.where(size == 0, 1, size)
    for _ in range(rounds if len(cells) else 0):
        cells = _sums(sound, cells)
    per_part = max(1, PART_NUMBERS // dim)
    placed = stored(_nearest(sound, cells, 1), "cells")
    parts = {r["list"]: -(-r["n"] // per_part) for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    return Index(_dealt(placed, parts), cells, parts)


def _dealt(rows: DataFrame, parts: dict[int, int]) -> DataFrame:
    """``rows`` with ``part``, one of its list's parts by hashed id."""
    return rows.withColumn("part", F.pmod(F.xxhash64("id"), _lookup(parts)))


def _lookup(parts: dict[int, int]) -> F.Column:
    known = F.create_map(*(F.lit(x) for pair in sorted(parts.items()) for x in pair)) if parts else F.create_map(F.lit(0), F.lit(1))
    return F.coalesce(F.element_at(known, F.col("list").cast("int")), F.lit(0)).cast("long")


def search(index: Index, queries: DataFrame, k: int, probes: int = 1) -> DataFrame:
    """(query_id, rank, id, similarity): the ``k`` rows of highest cosine in each query's ``probes`` nearest lists.

    Similarities are rounded to six places and ties go to smaller ids; a row never
    answers itself, and a zero vector has similarity 0.  Queries that can't be
    indexed get no answer.
    """
    dim = index.cells.shape[1]
    sound = _sound(queries).where(F.size("vector") == dim)
    asked = stored(_nearest(sound, index.cells, probes), "asked")
    per_part = max(1, PART_NUMBERS // dim)
    query_parts = {r["list"]: -(-r["n"] // per_part) for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), _lookup(parts) - 1))
    key = ["list", "part", "query_part"]
    left = _dealt(asked.where(F.col("list").isin(sorted(index.parts))), query_parts).withColumnRenamed("part", "query_part").withColumn("part", each(index.parts))
    right = index.rows.where(F.col("list").isin(sorted(query_parts))).withColumn("query_part", each(query_parts))

    def compare(mine: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(rows):
            q, x = (np.stack(d["vector"].to_list()) for d in (mine, rows))
            q, x = (v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n) for v in (q, x))
            ids = rows["id"].to_numpy()
            for a in range(0, len(q), 256):
                s = np.round(q[a : a + 256] @ x.T, 6)
                for i, own in enumerate(mine["id"].to_numpy()[a : a + 256]):
                    place = np.flatnonzero(ids != own)
                    if len(place) > k:
                        low = np.partition(s[i, place], len(place) - k)[len(place) - k]
                        place = place[s[i, place] >= low]
                    best = place[np.lexsort((ids[place], -s[i, place]))[:k]]
                    out.append(pd.DataFrame({"query_id": own, "id": ids[best], "similarity": s[i, best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "similarity": []})

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
