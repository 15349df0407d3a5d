"""Exact similarity search over embedding columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block: a block's vectors are what is broadcast.
BLOCK = 2000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _first(places: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` places of highest score, rounded to six places, those of smaller ids first; a few more, as rounding may differ."""
    if len(places) <= k + 5:
        return places
    return places[np.lexsort((ids[places], -np.round(scores[places], 6)))[: k + 5]]


def cosine_top_k(queries: DataFrame, rows: DataFrame, k: int, threshold: float = -1.0, guard: str | None = None) -> DataFrame:
    """(query_id, rank, id, similarity): each query's ``k`` most similar rows at or above the threshold.

    ``queries`` and ``rows`` hold (id, vector) and, with ``guard``, a column that
    must be equal.  A row never answers itself.  Query vectors go out a bounded
    block at a time; rows are scored where they lie and only each batch's best
    are shuffled.  Ties go to smaller ids.  Vectors that are null, hold a null
    or non-finite number, or have another length than most rows take no part; a
    zero vector has similarity 0.
    """
    spark = rows.sparkSession
    names = ["id", "vector", *([guard] if guard else [])]
    v = F.col("vector")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    queries, rows = queries.select(*names).where(sound & F.col("id").isNotNull()), rows.select(*names).where(sound & F.col("id").isNotNull())
    most = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    queries, rows = (d.where(F.size("vector") == (most.dim if most else 0)) for d in (queries, rows))
    n_blocks = max(1, -(-queries.count() // BLOCK))
    found = None
    for b in range(n_blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).toPandas()
        q = np.stack([np.asarray(v, dtype=np.float64) for v in block["vector"]]) if len(block) else np.zeros((0, 1))
        norms = np.linalg.norm(q, axis=1, keepdims=True)
        held = spark.sparkContext.broadcast((block["id"].to_numpy(np.int64), q / np.where(norms == 0, 1, norms), block[guard].to_numpy() if guard else None))

        def score(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, unit, guards = held.value
            for batch in batches:
                if not len(ids) or not batch.num_rows:
                    continue
                own = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                size = np.linalg.norm(x, axis=1, keepdims=True)
                s = unit @ (x / np.where(size == 0, 1, size)).T
                ok = (own[None, :] != ids[:, None]) & (np.round(s, 9) >= threshold)
                if guards is not None:
                    ok &= batch.column(2).to_numpy(zero_copy_only=False)[None, :] == guards[:, None]
                s = np.where(ok, s, -np.inf)
                keep = min(k, s.shape[1])
                cut = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]
                out = [_first(np.flatnonzero(ok[i] & (s[i] >= cut[i] - 2e-6)), own, s[i], k) for i in range(len(ids))]  # rounding to six places comes later
                i, j = np.repeat(np.arange(len(ids)), [len(x) for x in out]), np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[j].astype(np.int64)), pa.array(s[i, j])], names=["query_id", "id", "similarity"])

        part = rows.mapInArrow(score, "query_id long, id long, similarity double")
        found = part if found is None else found.unionByName(part)
    rounded = found.withColumn("similarity", F.round("similarity", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return rounded.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
