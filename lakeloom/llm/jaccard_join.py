"""Exact Jaccard self-join on word shingles through a token-group matrix.

Texts with the same shingle set are one class; its member with the smallest id
stands for it.  Representatives are partitioned into groups of similar sets:
those that share their smallest shingle hash (among frequent shingles, where
those make up ``hot_percent`` of a set, so that near copies of one text stay
together whatever else each holds), split to at most ``group_size``.
The token-group matrix has a row for each (shingle, group) of a prefix of the
members' shingles.  A representative queries the matrix with its own prefix:
two sets that link share at least k shingles of prefixes of length
n - ceil(t n) + k, in any fixed order of shingles, so a group with fewer hits
holds no partner and is never looked at.  A cell of the matrix whose members
are all too short or too long for the query is no hit.  For the groups that are left, the
union of all their members' shingles bounds the overlap with the query; only
groups whose bound reaches t n are opened, and every member is then compared
exactly.  No link is lost, and no pairs are made within a group of copies.  A
set is sent once to each part of a group, where a member may query its own
group; sets go there from the task that reads the texts.

The order of shingles puts frequent ones last, so that a passage that thousands
of documents share makes no candidates.  Frequencies come from a sketch of
fixed size over all texts (``sketch_bits``); it only orders shingles, so its
errors cost time, never links.

Links become components by stars of edges, and inside a task only the edges
that join two different local components are sent on.

Defined results: a null or empty text, or one without words, has no shingles
and links with nothing; rows that repeat an id are one document whose texts
all count; rows with a null id get a null component; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import bounded, give_back_memory, join_few, map_texts, materialise, mix64, shingle_hashes, tidy
from lakeloom.llm.components import connected_components
from lakeloom.llm.subword_classifier import text_slices


@dataclass(frozen=True)
class Config:
    """``width``-word shingles; a link is similarity >= percent / 100."""

    width: int = 3
    percent: int = 90
    group_size: int = 256
    queries_per_task: int = 512
    sketch_bits: int = 22
    hot_level: int = 2
    hot_percent: int = 30
    slice_bytes: int = 2_000_000


def least_overlap(n: np.ndarray | int, percent: int):
    """ceil(percent n / 100): what a set of n shares with any set it links to, at least."""
    return (percent * n + 99) // 100


def hits_asked(n: np.ndarray | int):
    """Prefix shingles that two linked sets of size n (or more) must share."""
    return 1 + np.minimum(n // 20, 7)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequency_levels(docs: DataFrame, config: Config) -> np.ndarray:
    """A level for every sketch cell: 0 for rare shingles, more for frequent ones.  2**sketch_bits bytes."""
    import zstandard

    cells, piece, shift = 1 << config.sketch_bits, 1 << 14, np.uint64(64 - config.sketch_bits)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, counts = zstandard.ZstdCompressor(level=1), np.zeros(cells, dtype=np.uint32)
        for batch in batches:
            for _, part in text_slices(batch.column(0), config.slice_bytes):
                hashes, _ = shingle_hashes(part, config.width)
                counts += np.bincount((hashes >> shift).astype(np.int64), minlength=cells).astype(np.uint32)
        for i in range(0, cells, piece):
            if counts[i : i + piece].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // piece], pa.int32()), pa.array([press.compress(counts[i : i + piece].astype("<u4").tobytes())], pa.binary())], names=["piece", "counts"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, opener, sums = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.frombuffer(opener.decompress(data), dtype="<u4")
                sums[i] = c if i not in sums else sums[i] + c
        for i, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([press.compress(c.astype("<u4").tobytes())], pa.binary())], names=["piece", "counts"])

    schema = "piece int, counts binary"
    parts = map_texts(docs.select(F.col("text").cast("string").alias("text")), count, schema)
    # Dealt at random first, then by piece: a task holds one sketch at most, however many tasks there were.
    merged = parts.repartition("piece", F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(merge, schema).repartition("piece").mapInArrow(merge, schema)
    counts = np.zeros(cells, dtype=np.uint32)
    opener = zstandard.ZstdDecompressor()
    for r in merged.toLocalIterator():  # each piece comes once
        counts[r.piece * piece : (r.piece + 1) * piece] = np.frombuffer(opener.decompress(r.counts), dtype="<u4")
    levels = sketch_levels(counts)
    del counts
    give_back_memory()
    return levels


def sketch_levels(counts: np.ndarray, piece: int = 1 << 14) -> np.ndarray:
    """The level of each cell by its count; a piece at a time, as the driver holds the whole sketch."""
    mean = counts.sum(dtype=np.int64) / len(counts)
    limit = mean + 6 * np.sqrt(mean) + 8
    levels = np.zeros(len(counts), dtype=np.uint8)
    for i in range(0, len(counts), piece):
        own = counts[i : i + piece]
        levels[i : i + piece] = np.where(own <= limit, 0, 1 + np.floor(np.log2(np.maximum(own, 1) / limit))).astype(np.uint8)
    return levels


def shingle_profiles(docs: DataFrame, levels: np.ndarray, config: Config) -> DataFrame:
    """(doc_id, n, sig_a, sig_b, key, prefix): set size, set signature, smallest hash, and the rarest-first prefix."""
    shared, shift = docs.sparkSession.sparkContext.broadcast(levels), np.uint64(64 - config.sketch_bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            for row, part in text_slices(batch.column(1), config.slice_bytes):
                hashes, edges = shingle_hashes(part, config.width)
                with np.errstate(over="ignore"):
                    grade = level[(hashes >> shift).astype(np.int64)]
                    cells = (grade.astype(np.uint64) << np.uint64(58)) | (hashes >> np.uint64(6))
                    sums = [np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(hashes ^ np.uint64(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                n = np.diff(edges)
                take = n - least_overlap(n, config.percent) + np.minimum(hits_asked(n), least_overlap(n, config.percent))
                prefixes, key = [], np.zeros(len(part), dtype=np.uint64)
                for i in range(len(part)):
                    own = hashes[edges[i] : edges[i + 1]]
                    hot = own[grade[edges[i] : edges[i + 1]] >= config.hot_level]
                    if len(own):
                        key[i] = hot[0] if 100 * len(hot) >= config.hot_percent * len(own) and len(hot) else own[0]
                    prefixes.append(own[np.argsort(cells[edges[i] : edges[i + 1]], kind="stable")[: take[i]]].view(np.int64))
                size = np.array([len(p) for p in prefixes], dtype=np.int64)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, dtype=np.int64)
                with np.errstate(over="ignore"):
                    signs = [(s[edges[1:]] - s[edges[:-1]]).view(np.int64) for s in sums]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(part)), pa.array(n.astype(np.int64)), pa.array(signs[0]), pa.array(signs[1]), pa.array(key.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))], names=["doc_id", "n", "sig_a", "sig_b", "key", "prefix"])

    return map_texts(_texts(docs), run, "doc_id long, n long, sig_a long, sig_b long, key long, prefix array<long>")


def whole_sets(docs: DataFrame, work: DataFrame, config: Config) -> DataFrame:
    """``work`` (doc_id and other columns) with ``tokens``: the sorted shingle hashes of each named document.

    The rows of a document come as one list, so its text is hashed once; texts are shuffled only if ``work`` is large.
    """
    columns = [c for c in work.columns if c != "doc_id"]
    sent = work.groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("sent"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in text_slices(batch.column(1), config.slice_bytes):
                hashes, edges = shingle_hashes(part, config.width)
                raw = hashes.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(part)), batch.column(2).slice(row, len(part)), pa.array([raw[8 * a : 8 * b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["doc_id", "sent", "tokens"])

    texts = _texts(docs).join(F.broadcast(sent) if bounded(work) is not work else sent, "doc_id").select("doc_id", "text", "sent")
    sets = map_texts(texts, run, f"doc_id long, sent {sent.schema['sent'].dataType.simpleString()}, tokens binary")
    return sets.select("doc_id", "tokens", F.explode("sent").alias("to")).select("doc_id", *[f"to.{c}" for c in columns], "tokens")


class _Group:
    """An opened-on-demand group: its members' shingles, their union, and postings from union to members."""

    def __init__(self, ids: list[int], copies: list[int], sets: list[np.ndarray]) -> None:
        self.ids, self.copies = np.array(ids, dtype=np.int64), np.array(copies, dtype=np.int64)
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        self.union, places = np.unique(flat, return_inverse=True)
        order = np.argsort(places, kind="stable")
        self.postings = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(places, minlength=len(self.union)))])

    def partners(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """The members that link with a query set; none if the union's overlap rules them all out."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.union) or not len(tokens):
            return none
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if len(at) < least_overlap(len(tokens), percent):
            return none  # not opened
        sizes = self.first[at + 1] - self.first[at]
        places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[at], sizes)
        shared = np.bincount(self.postings[places], minlength=len(self.ids))
        return np.flatnonzero(100 * shared >= percent * (len(tokens) + self.sizes - shared))


def _open_groups(percent: int):
    """mapInArrow over rows (grp, part, role, doc_id, copies, asks, tokens), sorted by the first three.

    Role 0 are the group's members, of which those with ``asks`` query it too; role 1 are the queries of other groups' members.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, group, links, parent = None, [], None, {}, {}
        found: list[tuple] = []

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def ask(doc: int, copies: int, tokens: np.ndarray, own: bool) -> None:
            for m in group.partners(tokens, percent):
                other, many = int(group.ids[m]), int(group.copies[m])
                if other == doc or (own and other > doc):
                    continue
                links[doc] = links.get(doc, 0) + many
                links[other] = links.get(other, 0) + copies
                x, y = root(doc), root(other)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((doc, other))

        def gather() -> None:
            nonlocal group, members
            group = _Group([m[0] for m in members], [m[1] for m in members], [m[2] for m in members])
            for doc, copies, tokens, asks in members:
                if asks:
                    ask(doc, copies, tokens, True)
            members = []

        def flush() -> pa.RecordBatch:
            rows = [(a, b, 0) for a, b in found] + [(a, None, n) for a, n in links.items()]
            found.clear(), links.clear(), parent.clear()
            a, b, n = zip(*rows, strict=True) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "links"])

        for batch in batches:
            for grp, part, role, doc, copies, asks, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, part) != now:
                    if any(m[3] for m in members):
                        gather()
                    if found or links:
                        yield flush()
                    now, members, group = (grp, part), [], None
                tokens = np.frombuffer(raw, dtype="<u8")
                if role == 0:
                    members.append((doc, copies, tokens, asks))
                    continue
                if group is None:
                    gather()
                ask(doc, copies, tokens, False)
        if any(m[3] for m in members):
            gather()
        yield flush()

    return run


def token_hits(reps: DataFrame, config: Config) -> DataFrame:
    """(doc_id, grp, target): for each of (doc_id, grp, n, prefix) the groups that may hold a partner of smaller group or id.

    The token-group matrix and the queries to it are dealt by token in one
    exchange, as both read the same columns.
    """
    rows = reps.select("doc_id", "grp", "n", F.explode("prefix").alias("token")).repartition("token")
    matrix = rows.groupBy("token", "grp").agg(F.min("doc_id").alias("first"), F.min("n").alias("least"), F.max("n").alias("most")).withColumnRenamed("grp", "target")
    fits = (100 * F.col("most") >= config.percent * F.col("n")) & (config.percent * F.col("least") <= 100 * F.col("n"))
    hit = rows.join(matrix, "token").where("target < grp OR (target = grp AND first < doc_id)").where(fits)
    asked = F.lit(1) + F.least(F.floor(F.floor((config.percent * F.col("n") + 99) / 100) / 20), F.lit(7))
    hits = hit.groupBy("doc_id", "grp", "target").agg(F.count("*").alias("hits"), F.min("n").alias("n"))
    return hits.where(F.col("hits") >= asked).select("doc_id", "grp", "target")


def jaccard_components(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of (doc_id, text)."""
    profiles = materialise(shingle_profiles(docs, frequency_levels(docs, config), config), "profiles")
    some = profiles.where("n > 0 AND doc_id IS NOT NULL")
    sign = ["n", "sig_a", "sig_b"]
    classes = materialise(some.groupBy(*sign).agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("copies")), "classes")
    stand = some.drop("prefix").join(classes.withColumnRenamed("rep", "doc_id"), [*sign, "doc_id"]).dropDuplicates(["doc_id", *sign])
    large = stand.groupBy("key").agg(F.count("*").alias("in_key")).where(F.col("in_key") > config.group_size)  # other keys are one group
    split = F.pmod(F.xxhash64("doc_id"), F.ceil(F.coalesce("in_key", F.lit(1)) / config.group_size))
    reps = materialise(join_few(stand, large, ["key"], config.group_size).select("doc_id", *sign, "copies", F.xxhash64("key", split).alias("grp")), "representatives")
    # Rows may repeat; their prefixes are equal, and min(), unlike first(), lets both sides of the matrix share an exchange.
    prefixes = some.select("doc_id", *sign, "prefix").join(reps.select("doc_id", *sign, "grp"), ["doc_id", *sign]).groupBy("doc_id", *sign).agg(F.min("grp").alias("grp"), F.min("prefix").alias("prefix"))
    wanted = materialise(token_hits(prefixes, config), "candidates")

    # A member is sent to every part of its group, and asks in one of them if its own group is a candidate.
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    per_group = wanted.groupBy("target").agg(F.ceil(F.count("*") / config.queries_per_task).alias("parts"))
    inner = wanted.where("grp = target").select("doc_id", "grp", F.lit(True).alias("inner"))
    members = reps.select("doc_id", "grp", "copies").join(per_group, F.col("grp") == F.col("target")).join(inner, ["doc_id", "grp"], "left").withColumn("turn", part)
    members = members.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("doc_id", "grp", "part", F.lit(0).alias("role"), "copies", (F.col("inner").isNotNull() & (F.col("part") == F.col("turn"))).alias("asks"))
    queries = wanted.where("grp <> target").join(per_group, "target").select("doc_id", F.col("target").alias("grp"), part.alias("part"), F.lit(1).alias("role")).join(reps.select("doc_id", "copies"), "doc_id").select("doc_id", "grp", "part", "role", "copies", F.lit(False).alias("asks"))
    work = materialise(members.unionByName(queries), "work")
    opened = whole_sets(docs, work, config).select("grp", "part", "role", "doc_id", "copies", "asks", "tokens").repartition("grp", "part").sortWithinPartitions("grp", "part", "role", "doc_id").mapInArrow(tidy(_open_groups(config.percent)), "a long, b long, links long")
    opened = materialise(opened, "links")

    roots = connected_components(opened.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    links = opened.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = classes.join(roots, "rep", "left").join(links, "rep", "left").select(*sign, "copies", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = materialise(named, "named")
    many, few = named.where(F.col("copies") > config.group_size).drop("copies"), named.where(F.col("copies") <= config.group_size).drop("copies")
    told = materialise(join_few(some.select("doc_id", *sign), many, sign, config.group_size), "told")  # large classes first, then no key is hot
    linked = told.where("component IS NOT NULL").unionByName(told.where("component IS NULL").select("doc_id", *sign).join(few, sign))
    linked = linked.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")
    alone = profiles.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


#: DuckDB SQL for the rows of jaccard_components() with the default settings: all pairs that share a shingle, and their closure.
JOIN_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s FROM w
), n AS (
  SELECT doc_id, len(s) AS n FROM s
), e AS (
  SELECT doc_id, unnest(s) AS x FROM s
), p AS (
  SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT i, j FROM p JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * c >= 90 * (x.n + y.n - c)
), u AS (
  SELECT i, j FROM l UNION ALL SELECT j, i FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT u.j, r.root FROM r JOIN u ON u.i = r.node
), c AS (
  SELECT node, min(root) AS component FROM r GROUP BY 1
), k AS (
  SELECT i, count(*) AS links FROM u GROUP BY 1
)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, component AS component_id, coalesce(links, 0) AS n_links FROM n JOIN c ON c.node = n.doc_id LEFT JOIN k ON k.i = n.doc_id
"""
