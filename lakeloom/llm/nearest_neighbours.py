"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors of largest inner product become vectors of smallest distance once each
row is divided by the largest norm and given one more coordinate that makes
its length 1, and each query is made a unit vector.  Several tables hash them
with Gaussian (2-stable) projections cut into cells of ``cell`` width.  A query
visits, in each table, its own bucket and the ``probes`` buckets that differ in
a few cells, in the order of their estimated success: the squared distances to
the cell borders that would have to be crossed, summed.

Equal vectors are one entry with its smallest ``k + 1`` ids, which is all that
ties can ask for.  Buckets are dealt to tasks by hash, to as many tasks as
``task_rows`` asks for; a bucket above ``bucket_rows`` is dealt in several
parts that a query all visits, so no row is left out.  Probes go in rounds,
likeliest first: after a round each query knows the score of its ``k + 1``-th
entry so far, and later rounds send on only entries that reach it, so what
leaves the tasks depends on the queries and ``k``, not on the number of tasks.
The candidates are scored again, exactly, on the original vectors in double
precision.  Queries that found fewer than ``k`` rows go on to slices of all
entries, in rounds of the same kind.

Defined results: null vectors, and vectors that are zero or hold a null or
non-finite number, or have another length than most, take no part; a query
isn't its own neighbour, but another id with the same vector is; rows that
repeat an id and its vector count once; rows with a null id take no part; an
empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import bounded, materialise, mix64


@dataclass(frozen=True)
class Config:
    """Tables, hash functions each, cell width, probes a table by the end of each round, rows of a bucket's part and of a task."""

    tables: int = 4
    functions: int = 6
    cell: float = 2.0
    probes: tuple[int, ...] = (4, 61)
    bucket_rows: int = 20_000
    task_rows: int = 50_000
    seed: int = 17


class _Hash:
    """The projections of all tables, and the perturbations in a fixed list."""

    def __init__(self, dim: int, config: Config) -> None:
        rng = np.random.default_rng(config.seed)
        self.config = config
        self.a = rng.normal(size=(config.tables, dim + 1, config.functions))
        self.b = rng.uniform(0, config.cell, (config.tables, config.functions))
        sets = [()]
        for r in range(1, min(4, config.functions) + 1):
            sets += [tuple(zip(js, signs, strict=True)) for js in itertools.combinations(range(config.functions), r) for signs in itertools.product((0, 1), repeat=r)]
        self.uses = np.zeros((len(sets), 2 * config.functions))
        self.moves = np.zeros((len(sets), config.functions), dtype=np.int64)
        for i, s in enumerate(sets):
            for j, sign in s:
                self.uses[i, 2 * j + sign] = 1
                self.moves[i, j] = 2 * sign - 1

    def _bucket(self, table: int, cells: np.ndarray) -> np.ndarray:
        h = np.full(cells.shape[:-1], np.uint64(table + 1))
        with np.errstate(over="ignore"):
            for j in range(cells.shape[-1]):
                h = mix64(h * np.uint64(31) + cells[..., j].astype(np.int64).view(np.uint64))
        return h.view(np.int64)

    def rows(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables): the bucket of each row in each table."""
        return np.stack([self._bucket(t, np.floor((unit @ self.a[t] + self.b[t]) / self.config.cell)) for t in range(self.config.tables)], axis=1)

    def probes(self, unit: np.ndarray) -> np.ndarray:
        """(n, probes, tables): the buckets each query visits, its own and then the likeliest first."""
        out = []
        n = min(self.config.probes[-1], len(self.moves))
        for t in range(self.config.tables):
            f = (unit @ self.a[t] + self.b[t]) / self.config.cell
            cell = np.floor(f)
            down = f - cell
            costs = np.stack([down**2, (1 - down) ** 2], axis=2).reshape(len(unit), -1) @ self.uses.T
            best = np.argsort(costs, axis=1, kind="stable")[:, :n]
            out.append(self._bucket(t, cell[:, None, :] + self.moves[best]))
        return np.stack(out, axis=2)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= cut - 1e-9 * (1 + abs(cut))  # rounding never decides here; the exact scores do later
        ids, scores = ids[near], scores[near]
    return ids, scores


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))


def search(rows: DataFrame, is_query: Column, k: int = 20, config: Config = Config(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product found for each query row."""
    spark = rows.sparkSession
    usable = rows.where(is_query.isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double") + 0.0).alias("v"), is_query.alias("asks")).where(_usable(F.col("v")))
    top = usable.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = top.dim
    usable = usable.where(F.size("v") == dim).dropDuplicates(["id", "v"])
    first = Window.partitionBy("v").orderBy("id")
    entries = usable.select("id", "v").withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    entries = materialise(entries.select(F.col("ids")[0].alias("entry"), "ids", "v"), "entries")
    asked = materialise(usable.where("asks").select(F.col("id").alias("query_id"), "v").join(entries.select("entry", "v"), "v").select("query_id", "entry"), "queries")
    queries = materialise(entries.select("entry", "v").join(asked.select("entry").distinct(), "entry"), "query-vectors")
    largest, n_entries = entries.agg(F.max(_dot(F.col("v"), F.col("v"))), F.count("*")).first()
    largest = largest**0.5
    hashing = spark.sparkContext.broadcast(_Hash(dim, config))  # its size depends on dim and the settings alone

    def hash_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim) / largest
            unit = np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(hashing.value.rows(unit))], names=["entry", "buckets"])

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = [0, *config.probes]
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            buckets = hashing.value.probes(np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1))
            for i, (a, b) in enumerate(itertools.pairwise(rounds)):
                part = buckets[:, a:b].reshape(len(x), -1)
                if part.shape[1]:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), i), pa.int32()), _lists(part)], names=["entry", "round", "buckets"])

    placed = materialise(entries.select("entry", "v").mapInArrow(hash_rows, "entry long, buckets array<long>").select("entry", F.explode("buckets").alias("bucket")), "buckets")
    large = materialise(placed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > config.bucket_rows).select("bucket", F.floor(F.col("n") / config.bucket_rows + 1).alias("parts")), "large-buckets")
    large = bounded(large)  # at most entries * tables / bucket_rows
    visits = queries.mapInArrow(probe, "entry long, round int, buckets array<long>").select("entry", "round", F.explode(F.array_distinct("buckets")).alias("bucket"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    cell = lambda part: F.xxhash64("bucket", part).alias("cell")
    placed = materialise(placed.join(large, "bucket", "left").select("entry", cell(F.pmod(F.xxhash64("entry"), parts))), "cells")
    visits = materialise(visits.join(large, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select("entry", "round", cell(F.col("part"))), "visits")

    found = spark.createDataFrame([], "query long, entry long, score double")
    for i in range(len(config.probes)):
        found = _round(placed, visits.where(F.col("round") == i).drop("round"), entries, queries, found, n_entries * config.tables, dim, k, config)
    ids = entries.select("entry", "ids")
    reached = found.join(ids.select("entry", F.size("ids").alias("n")), "entry").groupBy(F.col("query").alias("entry")).agg(F.sum("n").alias("n"))
    short = materialise(queries.join(reached, "entry", "left").where(F.coalesce("n", F.lit(0)) < k + 1).select("entry"), "short-queries")
    if not short.isEmpty():
        slices, done, step = -(-n_entries // config.bucket_rows), 0, 1
        sliced = entries.select("entry", F.pmod(F.xxhash64("entry"), F.lit(slices)).alias("cell"))
        while done < slices:  # eight times as many slices a round
            upto = min(slices, done + step)
            found = _round(sliced, short.select("entry", F.explode(F.sequence(F.lit(done).cast("long"), F.lit(upto - 1).cast("long"))).alias("cell")), entries, queries, found, n_entries, dim, k, config)
            done, step = upto, step * 8
    exact = found.join(entries.select("entry", "ids", F.col("v").alias("w")), "entry").join(queries.select(F.col("entry").alias("query"), "v"), "query").select("query", F.explode("ids").alias("vec_id"), _dot(F.col("v"), F.col("w")).alias("score"))
    pairs = asked.join(exact, F.col("entry") == F.col("query")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _round(placed: DataFrame, visits: DataFrame, entries: DataFrame, queries: DataFrame, found: DataFrame, n_placed: int, dim: int, k: int, config: Config) -> DataFrame:
    """The best entries of each query among those ``found`` and those in the cells it visits.

    ``placed`` (entry, cell) says where entries lie.  Cells are dealt to tasks;
    a task gets each entry and each query once, with their cells there.
    """
    n_tasks = max(placed.sparkSession.sparkContext.defaultParallelism, -(-n_placed // config.task_rows))
    task = F.pmod(F.xxhash64("cell"), F.lit(n_tasks)).cast("int").alias("task")
    floor = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))).where(F.col("place") == k + 1).select(F.col("query").alias("entry"), F.col("score").alias("floor"))
    gather = lambda df: df.groupBy(task, "entry").agg(F.collect_set("cell").alias("to"))  # noqa: E731  at most the cells of one entry or query
    data = gather(placed).join(entries.select("entry", "v"), "entry").withColumn("floor", F.lit(None).cast("double"))
    asks = gather(visits).join(queries.join(floor, "entry", "left"), "entry")
    work = data.select("task", F.lit(0).alias("role"), "entry", "v", "to", "floor").unionByName(asks.select("task", F.lit(1).alias("role"), "entry", "v", "to", "floor"))

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, cells, owners, size = [], [], [], [], 0
        table = None
        for batch in batches:
            n_data = int((batch.column(1).to_numpy() == 0).sum())  # entries come before queries
            entry, x, to = batch.column(2).to_numpy(), _matrix(batch.column(3), dim), batch.column(4)
            lens, flat = pc.list_value_length(to).to_numpy(), to.flatten().to_numpy()
            ends = np.cumsum(lens)
            if n_data:
                names.append(entry[:n_data].copy())
                vectors.append(x[:n_data])
                cells.append(flat[: ends[n_data - 1]].copy())
                owners.append(np.repeat(np.arange(n_data) + size, lens[:n_data]))
                size += n_data
            if n_data == len(entry):
                continue
            if table is None:
                table = np.concatenate(vectors) if vectors else np.zeros((0, dim))
                label = np.concatenate(names) if names else np.zeros(0, dtype=np.int64)
                held = np.concatenate(cells) if cells else np.zeros(0, dtype=np.int64)
                order = np.argsort(held, kind="stable")
                held, owner = held[order], (np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64))[order]
                vectors.clear()
            left, right = np.searchsorted(held, flat, side="left"), np.searchsorted(held, flat, side="right")
            floors = batch.column(5).to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for i in range(n_data, len(entry)):
                at = np.unique(np.concatenate([owner[left[j] : right[j]] for j in range(ends[i] - lens[i], ends[i])]))
                if not len(at):
                    continue
                scores = table[at] @ x[i]
                if not np.isnan(floors[i]):
                    near = scores >= floors[i] - 1e-9 * (1 + abs(floors[i]))
                    at, scores = at[near], scores[near]
                out.append((entry[i], *_best(label[at], scores, k + 1)))
            yield _pairs(out)

    new = work.repartitionById(n_tasks, F.col("task")).sortWithinPartitions("role").select("task", "role", "entry", "v", "to", "floor").mapInArrow(match, "query long, entry long, score double")
    return materialise(_ranked(found.unionByName(new), k), "best")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best entries of each query: a few more than asked for, so that rounding doesn't decide."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))
    return found.dropDuplicates(["query", "entry"]).withColumn("place", place).where(F.col("place") <= k + 6).drop("place")


def _pairs(out: list[tuple]) -> pa.RecordBatch:
    n = [len(s) for _, _, s in out]
    query = np.repeat(np.array([q for q, _, _ in out], dtype=np.int64), n)
    entry = np.concatenate([e for _, e, _ in out]) if out else np.zeros(0, dtype=np.int64)
    score = np.concatenate([s for _, _, s in out]) if out else np.zeros(0)
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(entry.astype(np.int64)), pa.array(score)], names=["query", "entry", "score"])
