"""Merkle dataset manifest: leaves, stored levels, and a recursive query that climbs from every leaf to the root.

Leaves are hashed where the documents lie; only digests are shuffled.  Their
places within a language come from one range partitioning and the partitions'
counts, so no language is gathered in one task.  Every eight consecutive nodes
become their parent, level by level; a node row names its parent and keeps its
children's digests.  The climb is a recursive CTE over those rows that joins the
parent, appends the siblings and folds the (tampered) digest of every leaf.  Up to
eight leaves of a run have one path beyond their first step, so they climb as one
row: the siblings on it are appended once, the digests are folded leaf by leaf.

Upper nodes have all leaves below them.  Each node row is therefore stored once
for each block of 512 leaves below it, and a run joins the row of its own block:
a key of the climb's join has at most 64 runs at any height, and a level above
the third has one small row for each block.

Defined results: null fields hash as ``-``; an empty text is ``0:``; a null
language is a language of its own, the first; null ids come first in their
language and are never tampered with; repeated ids are ordered by their leaves,
and equal leaves are interchangeable, so every copy gets a row with its own
place; a table of one row has that leaf as subroot and root; an empty table gives
no rows.  Columns beside doc_id, source, lang, n_chars and text are not read.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import bounded, join_few, materialise

#: Children of a node, and leaves of a block (a power of it).
FAN = 8
BLOCK = 512

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The tree above the languages' trees.
TOP = -1


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(hexed: Column) -> Column:
    return F.unhex(F.sha2(hexed, 256))


def leaf_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, given): the leaf of each row, and the leaf that the climb starts from (tampered or not), as bytes."""
    plain = {name: F.col(name) for name in FIELDS}
    changed = plain | {"text": F.translate(F.col("text").cast("string"), _UPPER, _LOWER)}
    leaf, other = (_digest(F.concat(*(_field(fields[name]) for name in FIELDS))) for fields in (plain, changed))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf.alias("leaf"), F.when(tampered, other).alias("given")).withColumn("given", F.coalesce("given", "leaf"))


def numbered(rows: DataFrame, groups: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``name``, each row's place from 0 in its group; (groups, n)): ordered by ``order``, nulls first.

    Rows are range-partitioned once; a place is that in the partition plus the
    group's rows in earlier partitions.  ``rows`` must be a stored table.
    """
    at = F.monotonically_increasing_id()
    dealt = materialise(rows.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).withColumn("at", at).withColumn("part", F.shiftright("at", 33)), "ranges")
    parts = dealt.groupBy(*groups, "part").agg(F.min("at").alias("low"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialise(parts.withColumn("before", F.coalesce(before, F.lit(0))), "starts")
    own = starts.select(*(F.col(g).alias(f"own_{g}") for g in groups), F.col("part").alias("own_part"), "low", "before")
    same = F.col("part") == F.col("own_part")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"own_{g}"))
    placed = dealt.join(bounded(own), same).select(*rows.columns, (F.col("at") - F.col("low") + F.col("before")).alias(name))
    return placed, starts.groupBy(*groups).agg(F.sum("rows").alias("n"))


def _parents(level: DataFrame) -> DataFrame:
    """(tree, n, idx, digest, children) of the parents of (tree, n, idx, digest)."""
    run = F.transform(F.sort_array(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
    above = level.groupBy("tree", "n", F.shiftright("idx", 3).alias("parent")).agg(run.alias("children"))
    return above.select("tree", "n", F.col("parent").alias("idx"), _digest(_joined(F.col("children"))).alias("digest"), "children")


def _joined(digests: Column) -> Column:
    return F.concat_ws("", F.transform(digests, lambda d: F.lower(F.hex(d))))


def build_levels(level: DataFrame, height: int, most: int) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """Stored levels above (tree, n, idx, digest), by height and with children, and (tree, digest) of the trees' roots.

    ``n`` is the tree's number of leaves, ``most`` the largest, ``height`` that of
    the given level.  A level has an eighth of the rows of the one below, so there
    are few, whatever ``most`` is.
    """
    levels, ended = [], lambda rows, k: rows.where(F.col("n") <= FAN**k).select("tree", "digest")
    roots = ended(level, height)
    while FAN**height < most:
        level = materialise(_parents(level.where(F.col("n") > FAN**height)), f"level-{height + 1}")
        height += 1
        levels.append((height, level))
        roots = roots.unionByName(ended(level, height))
    return levels, materialise(roots, "roots")


def _name(tree: Column, level: int, idx: Column) -> Column:
    return F.concat_ws("/", tree.cast("string"), F.lit(str(level)), idx.cast("string"))


def node_rows(levels: list[tuple[int, DataFrame]], tops: list[tuple[int, DataFrame]], trees: DataFrame) -> DataFrame:
    """(block, node, parent, slot, children): the stored nodes, each once for every block of leaves below it.

    ``parent`` is null at the root and ``slot`` the node's place among its
    siblings; ``trees`` has (tree, n).
    """
    rows = []
    for k, level in levels:
        per = FAN**k  # leaves below a full node
        low = F.floor(F.col("idx") * per / BLOCK) if per < BLOCK else F.col("idx") * (per // BLOCK)
        last = F.floor((F.col("n") - 1) / BLOCK).cast("long")
        high = low if per <= BLOCK else F.least((F.col("idx") + 1) * (per // BLOCK) - 1, last)
        root = F.col("n") <= per
        up = F.when(~root, _name(F.col("tree"), k + 1, F.shiftright("idx", 3)))
        if tops:
            up = F.coalesce(up, _name(F.lit(TOP), 1, F.shiftright("tree", 3)))
        slot = F.when(root, F.col("tree") % FAN).otherwise(F.col("idx") % FAN)
        rows.append(level.select(F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("at"), "tree", _name(F.col("tree"), k, F.col("idx")).alias("node"), up.alias("parent"), slot.alias("slot"), "children"))
    for k, level in tops:
        mine = trees.select("tree", "n", F.shiftright("tree", 3 * k).alias("idx"))
        up = F.lit(None).cast("string") if k == len(tops) else _name(F.lit(TOP), k + 1, F.shiftright("idx", 3))
        blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK).cast("long")))
        rows.append(mine.join(level.select("idx", "children"), "idx").select(blocks.alias("at"), "tree", _name(F.lit(TOP), k, F.col("idx")).alias("node"), up.alias("parent"), (F.col("idx") % FAN).alias("slot"), "children"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.select(F.concat_ws("/", "tree", "at").alias("block"), "node", "parent", "slot", "children")


#: The climb.  A row, a run of leaves, stands at ``parent``, the node above what it has folded so far.
CLIMB_SQL = """
WITH RECURSIVE climb (tree, idx, block, parent, slot, folded, proof) AS (
  SELECT tree, idx, block, parent, slot, folded, CAST(X'' AS BINARY) FROM {runs}
  UNION ALL
  SELECT c.tree, c.idx, c.block, n.parent, n.slot,
         transform(c.folded, own -> unhex(sha2(concat_ws('', transform(n.children, (d, i) -> lower(hex(if(i = c.slot, own, d))))), 256))),
         concat(c.proof, unhex(concat_ws('', transform(filter(n.children, (d, i) -> i <> c.slot), d -> hex(d)))))
  FROM climb c JOIN {nodes} n ON n.block = c.block AND n.node = c.parent
)
SELECT tree, idx, folded, proof FROM climb WHERE parent IS NULL
"""


@contextlib.contextmanager
def _recursion_unbounded(spark: SparkSession) -> Iterator[None]:
    """The recursive query makes a row for each run and level; Spark stops at a million rows by default."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of documents."""
    spark = docs.sparkSession
    digests = materialise(leaf_digests(docs), "leaves")
    placed, sizes = numbered(digests, ["lang"], ["doc_id", "leaf", "given"], "idx")
    # Languages in order, nulls first: places of their own, by the same means.
    ordered, _ = numbered(materialise(sizes.withColumn("all", F.lit(0)), "languages"), ["all"], ["lang"], "tree")
    trees = materialise(ordered.select("lang", "tree", "n"), "trees")
    how_many = trees.count()
    told = bounded(trees.select(F.col("lang").alias("own_lang"), "tree", "n"))
    leaves = placed.join(told, F.col("lang").eqNullSafe(F.col("own_lang"))).select("doc_id", "leaf", "given", "tree", "idx", "n")
    several = leaves.groupBy("tree", "n", F.shiftright("idx", 3).alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "leaf", "given", "doc_id"))).alias("leaves")).withColumnRenamed("run", "idx")
    runs = materialise(several, "runs")
    children = F.transform("leaves", lambda x: x["leaf"])
    first = runs.select("tree", "n", "idx", F.when(F.col("n") > 1, _digest(_joined(children))).otherwise(F.col("leaves")[0]["leaf"]).alias("digest"))

    levels, subroots = build_levels(first, 1, trees.agg(F.max("n")).first()[0] or 0)
    tops: list[tuple[int, DataFrame]] = []
    roots = subroots
    if how_many > 1:
        tops, roots = build_levels(subroots.select(F.lit(TOP).alias("tree"), F.lit(how_many).alias("n"), F.col("tree").alias("idx"), "digest"), 0, how_many)
    root = roots.select(F.lower(F.hex("digest"))).first()
    up = F.when(F.col("n") > FAN, _name(F.col("tree"), 2, F.shiftright("idx", 3)))
    if tops:
        up = F.coalesce(up, _name(F.lit(TOP), 1, F.shiftright("tree", 3)))
    slot = F.when(F.col("n") > FAN, F.col("idx") % FAN).otherwise(F.col("tree") % FAN)
    block = F.concat_ws("/", "tree", F.floor(F.col("idx") * FAN / BLOCK))
    parent = lambda own, at: _digest(_joined(F.transform(children, lambda d, i: F.when(i == at, own).otherwise(d))))
    folded = F.when(F.col("n") > 1, F.transform("leaves", lambda x, at: parent(x["given"], at))).otherwise(F.transform("leaves", lambda x: x["given"]))
    start = runs.select("tree", "idx", block.alias("block"), up.alias("parent"), slot.alias("slot"), folded.alias("folded"))
    if levels or tops:
        nodes = materialise(node_rows(levels, tops, trees), "nodes")
    else:
        nodes = start.limit(0).select("block", F.col("parent").alias("node"), "parent", "slot", F.col("folded").alias("children"))
    with _recursion_unbounded(spark):
        climbed = materialise(spark.sql(CLIMB_SQL, runs=start, nodes=nodes), "climbed")
    own = F.posexplode("leaves").alias("at", "x")
    rows = runs.join(climbed, ["tree", "idx"]).select("tree", "n", "leaves", "folded", "proof", own)
    others = F.when(F.col("n") > 1, _joined(F.transform(F.filter("leaves", lambda _, i: i != F.col("at")), lambda x: x["leaf"]))).otherwise(F.lit(""))
    rows = rows.select("tree", F.col("x.doc_id").alias("doc_id"), F.lower(F.hex("x.leaf")).alias("leaf"), F.sha2(F.concat(others, F.lower(F.hex("proof"))), 256).alias("proof_sha256"), F.lower(F.hex(F.get("folded", F.col("at")))).alias("folded_root"))
    told = join_few(rows, subroots.select("tree", F.lower(F.hex("digest")).alias("subroot")), ["tree"], 512)
    whole = F.lit(root[0] if root else None).cast("string")
    return told.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))


#: DuckDB SQL for crc32 of a decimal id, a bit at a time.
CRC32_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1))), 4294967295)"""

_FIELD_SQL = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || ({0}::VARCHAR) END"
_LEAF_SQL = "sha256(" + " || ".join(_FIELD_SQL.format(f) for f in FIELDS[:-1]) + " || {0})"

#: DuckDB SQL for the rows of manifest().
MANIFEST_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, translate(text, '{_UPPER}', '{_LOWER}') AS changed, {CRC32_SQL} % 3 = 0 AS tampered FROM documents
), h AS (
  SELECT doc_id, lang, {_LEAF_SQL.format(_FIELD_SQL.format("text"))} AS leaf, {_LEAF_SQL.format(_FIELD_SQL.format("changed"))} AS other, tampered FROM d
), l AS (
  SELECT *, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM h
), up AS (
  SELECT tree, 0 AS level, idx, leaf AS h, n FROM l
  UNION ALL
  SELECT tree, any_value(level) + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM up WHERE n > 1 GROUP BY tree, idx // 8
), s AS (
  SELECT tree, h AS subroot FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, tree AS idx, subroot AS h, (SELECT count(*) FROM s) AS n FROM s
  UNION ALL
  SELECT any_value(level) + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY idx // 8
), nodes AS (
  SELECT tree, level, idx, h FROM up UNION ALL SELECT -1, level, idx, h FROM top
), runs AS (
  SELECT tree, level, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM nodes GROUP BY 1, 2, 3
), g AS (
  SELECT count(*) AS langs FROM s
), c AS (
  SELECT tree * 1000000000 + idx AS k, CASE WHEN n = 1 THEN -1 ELSE tree END AS tree, 0 AS level, CASE WHEN n = 1 THEN tree ELSE idx END AS idx, CASE WHEN n = 1 THEN langs ELSE n END AS n,
         CASE WHEN tampered THEN coalesce(other, leaf) ELSE leaf END AS folded, '' AS proof FROM l CROSS JOIN g
  UNION ALL
  SELECT k, CASE WHEN c.tree >= 0 AND c.n <= 8 THEN -1 ELSE c.tree END, CASE WHEN c.tree >= 0 AND c.n <= 8 THEN 0 ELSE c.level + 1 END,
         CASE WHEN c.tree >= 0 AND c.n <= 8 THEN c.tree ELSE c.idx // 8 END, CASE WHEN c.tree >= 0 AND c.n <= 8 THEN langs ELSE (c.n + 7) // 8 END,
         sha256(array_to_string(list_transform(hs, lambda h, i: CASE WHEN i = c.idx % 8 + 1 THEN c.folded ELSE h END), '')),
         c.proof || array_to_string(list_filter(hs, lambda h, i: i <> c.idx % 8 + 1), '')
  FROM c JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.run = c.idx // 8 CROSS JOIN g WHERE c.n > 1
), e AS (
  SELECT k, folded, proof FROM c WHERE tree = -1 AND n = 1
), root AS (
  SELECT h AS root FROM top WHERE n = 1
)
SELECT l.doc_id, l.leaf, s.subroot, root.root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = root.root AS verified
FROM l JOIN e ON e.k = l.tree * 1000000000 + l.idx JOIN s ON s.tree = l.tree CROSS JOIN root
"""
