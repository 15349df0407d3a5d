"""SimHash near-duplicates by covering locality-sensitive hashing: no pair within the radius is missed.

Every bit position gets a nonzero vector of radius + 1 bits, in turn; a table is a
nonzero vector v, and its mask keeps the positions whose vector has an odd overlap
with v.  The vectors of at most ``radius`` differing positions span less than the
whole space, so some v is orthogonal to all of them: that table's mask keeps none
of the differing positions, and the pair has one key there.  For radius 3 there
are 15 tables of about 34 bits.

Only distinct fingerprints are hashed, and only a spanning forest of a bucket's
links leaves the task that compares its members, so copies and families make no
pairs.  A bucket beyond ``bucket_rows`` is refined: its free bits are cut in
radius + 1 spans, and two members within the radius agree on one of them.  That
halves the free bits or nearly so; once there are so few that their values are
fewer than ``bucket_rows``, the bucket's size is bounded by counting.

Defined results: a null or empty text, or one without words, has the fingerprint
zero and links like any other; a row with a null id has a fingerprint, links with
nothing and has a null component; repeated ids give a row each, and are one node;
an empty table gives no rows.  Columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import LOWER_BYTES, bounded, join_few, map_texts, materialise, string_bytes, tidy
from lakeloom.llm.components import connected_components

BITS = 64


@dataclass(frozen=True)
class Config:
    """``bucket_rows``: the members of a bucket that are compared in one task, at most."""

    width: int = 3
    radius: int = 3
    seed: int = 42
    bucket_rows: int = 4096
    copies: int = 256


def covering_masks(radius: int) -> list[int]:
    """One mask for each nonzero vector of radius + 1 bits, over 64 positions."""
    vectors = [1 + i % ((1 << radius + 1) - 1) for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 1 << radius + 1)]


def spans_of(free: int, radius: int) -> list[int]:
    """The set bits of ``free``, cut in radius + 1 spans of nearly equal size."""
    at = [i for i in range(BITS) if free >> i & 1]
    edges = [len(at) * k // (radius + 1) for k in range(radius + 2)]
    return [sum(1 << i for i in at[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: bytes, width: int, seed: int, piece: int = 1 << 16) -> int:
    """The fingerprint of a lower-cased text: a bit is set if over half of the shingles' XXH64 have it."""
    words = text.split()  # bytes split at space and at 0x09 to 0x0D
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for low in range(0, n, piece):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[low : low + piece], ends[low : low + piece], strict=True)), np.uint64, min(piece, n - low))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, config: Config) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = string_bytes(batch.column(1))
            fps = [_signed(simhash(LOWER_BYTES[data[a:b]].tobytes(), config.width, config.seed)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Places of linked pairs that connect all members of a bucket that links connect."""
    n = len(fps)
    found: list[tuple[int, int]] = []
    left = np.ones(n, dtype=bool)
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue and left.any():
            at = queue.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(fps[rest] ^ fps[at]) <= radius]
            left[near] = False
            queue += near.tolist()
            found += [(at, other) for other in near.tolist()]
    return found


def _compare_buckets(radius: int):
    """mapInArrow over (members: list of (fp, rep)): linked representatives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            edges, flat = lists.offsets.to_numpy(), lists.values
            fps, reps = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            out_a, out_b = [], []
            size = np.diff(edges)
            two = edges[:-1][size == 2]  # most buckets
            two = two[np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= radius]
            out_a.append(reps[two])
            out_b.append(reps[two + 1])
            for k in np.flatnonzero(size > 2).tolist():
                own = reps[edges[k] : edges[k + 1]]
                pairs = np.array(forest(fps[edges[k] : edges[k + 1]].view(np.uint64), radius), dtype=np.int64).reshape(-1, 2)
                out_a.append(own[pairs[:, 0]])
                out_b.append(own[pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_a, out_b)], names=["a", "b"])

    return run


def _keyed(rows: DataFrame, masks: DataFrame, on: list[str]) -> DataFrame:
    """(mask, key, fp, rep): each fingerprint under each of the masks that ``masks`` has for it."""
    found = rows.join(F.broadcast(masks), on) if on else rows.crossJoin(F.broadcast(masks))
    return found.select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"), "fp", "rep")


def linked_pairs(classes: DataFrame, config: Config) -> DataFrame:
    """(a, b) representatives of (fp, rep), distinct in fp, that connect all that links connect.

    Buckets that are small enough are compared at once; the members of larger
    ones go on to finer masks.
    """
    spark, found, masks = classes.sparkSession, None, covering_masks(config.radius)
    rows = _keyed(classes, spark.createDataFrame([(_signed(m),) for m in masks], "finer long"), [])  # a fixed number of rows
    while True:
        large = bounded(materialise(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > config.bucket_rows).select("mask", "key"), "large"))
        hot = sorted(r.mask for r in large.select("mask").distinct().collect() if r.mask != -1)  # few: of the masks of this round
        small = rows.join(large, ["mask", "key"], "left_anti") if hot else rows
        members = F.collect_list(F.struct("fp", "rep")).alias("members")
        pairs = small.groupBy("mask", "key").agg(members).where(F.size("members") > 1).select("members").mapInArrow(tidy(_compare_buckets(config.radius)), "a long, b long")
        pairs = materialise(pairs, "pairs")
        found = pairs if found is None else found.unionByName(pairs)
        if not hot:
            return found
        finer = [(m, _signed(m % (1 << BITS) | span)) for m in hot for span in spans_of(~m % (1 << BITS), config.radius)]
        kept = materialise(rows.join(large, ["mask", "key"], "left_semi"), "refined")
        rows = _keyed(kept, spark.createDataFrame(sorted(set(finer)), "mask long, finer long"), ["mask"])


def near_duplicates(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of (doc_id, text)."""
    rows = materialise(fingerprints(docs, config), "fingerprints")
    classes = materialise(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    # A repeated id with two texts is one node: its fingerprints are linked by the id itself.
    own = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    pairs = linked_pairs(classes.select("fp", "rep"), config)
    if not own.isEmpty():
        repeated = rows.join(bounded(materialise(own, "repeated")), "doc_id", "left_semi").distinct()
        pairs = pairs.unionByName(repeated.join(classes.select("fp", "rep"), "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    roots = connected_components(pairs).withColumnRenamed("node", "rep")
    named = materialise(classes.join(roots, "rep", "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id")), "named")
    many, few = (named.where(F.col("n") > config.copies).drop("n"), named.where(F.col("n") <= config.copies).drop("n"))
    told = materialise(join_few(rows, many, ["fp"], config.copies), "told")  # large classes first, then no key is hot
    known = told.where("component_id IS NOT NULL").unionByName(told.where("component_id IS NULL").drop("component_id").join(few, "fp", "left").select(*told.columns))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return known.select("doc_id", text.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
