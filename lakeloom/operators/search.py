"""Keyword search: postings and BM25."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75

#: Questions of one block: their terms and weights are what is broadcast.
BLOCK = 2000

_TERM = re.compile("[a-z0-9]+")


def terms(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf, length): the inverted index of a table."""
    split = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t")).withColumn("length", F.size("t"))
    return split.select("id", "length", F.explode("t").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def _words(text: str | None) -> list[str]:
    return _TERM.findall(text.lower()) if text else []


def bm25(queries: DataFrame, docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", every_term: bool = False) -> DataFrame:
    """(query_id, rank, id, score) of (query_id, text): each query's ``k`` best documents.

    Questions go out in blocks of bounded size; documents are scored where they
    lie, and a task sends on the ``k`` best of each question alone, so no common
    word becomes a hot key.  Lengths and counts are taken over all documents.
    With ``every_term`` only documents that hold all of a question's terms count.
    A null or empty text has no terms; ties go to smaller ids.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = queries.where(F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.array_distinct(terms(F.coalesce("text", F.lit("")))).alias("terms"))
    n_blocks = max(1, -(-asked.count() // BLOCK))
    found = None
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).orderBy("query_id").collect()  # about BLOCK rows
        number = {t: i for i, t in enumerate(sorted({t for r in rows for t in r.terms}))}
        stats, df = _counts(texts, number)
        held = spark.sparkContext.broadcast((number, *_weights([r.terms for r in rows], number, stats[0], df), np.array([r.query_id for r in rows], dtype=np.int64), stats[1] or 1.0))

        def score(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            number, first, asks, idf, n_terms, names, mean = held.value
            best: list[list[tuple[float, int]]] = [[] for _ in names]  # at most a few k pairs of each question
            floor = np.full(len(names), -np.inf)  # what a document must reach to be among a question's k best so far
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = _words(text)
                    counts = Counter(map(number.get, words))
                    counts.pop(None, None)
                    if not counts:
                        continue
                    at = np.fromiter(counts, dtype=np.int64, count=len(counts))
                    tf = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
                    share = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
                    sizes = first[at + 1] - first[at]
                    places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[at], sizes)
                    sums = np.bincount(asks[places], weights=np.repeat(share, sizes), minlength=len(names))
                    hits = np.bincount(asks[places], minlength=len(names))
                    for q in np.flatnonzero((hits >= n_terms if every_term else hits > 0) & (hits > 0) & (sums >= floor)):
                        best[q].append((-round(float(sums[q]), 5), doc))
                        if len(best[q]) >= 2 * k + 16:
                            best[q] = sorted(best[q])[:k]
                            floor[q] = -best[q][-1][0] - 1e-5  # rounding to five places can't lift a lower sum to the k-th
            out = [(int(names[q]), d, -x) for q, pairs in enumerate(best) for x, d in sorted(pairs)[:k]]
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "id", "score"])

        part = texts.mapInArrow(score, "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _counts(texts: DataFrame, number: dict[str, int]) -> tuple[tuple[int, float], np.ndarray]:
    """((documents, mean length), documents that hold each numbered term), over all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(number)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = _words(text)
                docs, length = docs + 1, length + len(words)
                df.update(set(map(shared.value.get, words)) - {None})
        keys = [-2, -1, *df]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([docs, length, *df.values()], pa.int64())], names=["term", "n"])

    sums = {r.term: r.n for r in texts.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the terms of a block
    docs = sums.get(-2, 0)
    return (docs, sums.get(-1, 0) / docs if docs else 0.0), np.array([sums.get(i, 0) for i in range(len(number))], dtype=np.float64)


def _weights(asked: list[list[str]], number: dict[str, int], docs: int, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of each term's questions, the questions, idf of each term, terms of each question)."""
    pairs = sorted((number[t], q) for q, ts in enumerate(asked) for t in ts)
    term = np.array([t for t, _ in pairs], dtype=np.int64)
    return np.searchsorted(term, np.arange(len(number) + 1)), np.array([q for _, q in pairs], dtype=np.int64), np.log(1 + (docs - df + 0.5) / (df + 0.5)), np.array([len(t) for t in asked])


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, vector): a text's term counts, added up by the first two hexadecimal digits of the term's md5."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = lru_cache(maxsize=200_000)(lambda t: hashlib.md5(t.encode()).digest()[0])
        for batch in batches:
            rows = [np.bincount(np.fromiter(map(bucket, _words(t)), dtype=np.int64), minlength=256) for t in batch.column(1).to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * 256, pa.int32()), pa.array(flat.astype(np.float64)))], names=["id", "vector"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, vector array<double>")


def merge_hits(near: DataFrame, worded: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, similarity, channel): vector hits and the keyword hits that aren't among them, the most similar first.

    A question has at most ``k`` and its keyword hits.
    """
    many = worded.groupBy("query_id").agg(F.count("*").alias("more"))
    both = near.select("query_id", "id", "similarity", F.lit("vector").alias("channel")).unionByName(worded.select("query_id", "id", "similarity", F.lit("keyword").alias("channel")))
    one = both.groupBy("query_id", "id").agg(F.max_by(F.struct("similarity", "channel"), F.col("channel")).alias("x")).select("query_id", "id", "x.similarity", "x.channel")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    ranked = one.withColumn("rank", rank).join(many, "query_id", "left")
    return ranked.where(F.col("rank") <= k + F.coalesce("more", F.lit(0))).select("query_id", "rank", "id", "similarity", "channel")


def reciprocal_rank_fusion(parts: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """(query_id, rank, id, score) of several ranked lists: the sum of 1 / (constant + rank)."""
    whole = parts[0].select("query_id", "id", "rank")
    for p in parts[1:]:
        whole = whole.unionByName(p.select("query_id", "id", "rank"))
    fused = whole.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
