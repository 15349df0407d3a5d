"""The product graph: which sources offer which products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators.graph import degrees, reach, related, undirected
from lakeloom.plans.registry import alias, query, table

EDGES_SQL = "e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return table(spark, sf_dir, "lineitem").select(name("p", "l_partkey").alias("a"), name("s", "l_suppkey").alias("b")).distinct()


@query(f"WITH {EDGES_SQL} SELECT a AS node, md5(a) AS node_id, count(*) AS degree FROM u GROUP BY 1")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every node."""
    return _degrees(edges(spark, sf_dir))


def _degrees(e: DataFrame) -> DataFrame:
    return degrees(undirected(e)).select("node", F.md5("node").alias("node_id"), "degree")


@query(f"WITH {EDGES_SQL} SELECT left(a, 1) AS kind, count(DISTINCT a) AS nodes, count(*) AS edge_ends FROM u GROUP BY 1")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edge ends by kind."""
    return _statistics(edges(spark, sf_dir))


def _statistics(e: DataFrame) -> DataFrame:
    return undirected(e).groupBy(F.substring("a", 1, 1).alias("kind")).agg(F.countDistinct("a").alias("nodes"), F.count("*").alias("edge_ends"))


_HOPS_SQL = f"""WITH RECURSIVE {EDGES_SQL}, h AS (SELECT DISTINCT a AS seed, a AS node, 0 AS hops FROM u WHERE CAST(substr(a, 2) AS BIGINT) % 100 = 0 UNION SELECT seed, b, hops + 1 FROM h JOIN u ON a = node WHERE hops < 2)
SELECT seed, node, min(hops) AS hops FROM h GROUP BY 1, 2"""


@query(_HOPS_SQL)
def two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within two steps of each node whose number is divisible by 100, the stated set of seeds."""
    both = undirected(edges(spark, sf_dir))
    seeds = both.where(F.substring("a", 2, 20).cast("long") % 100 == 0).select(F.col("a").alias("seed"), F.col("a").alias("node"))
    return reach(both, seeds, 2)


@query("""WITH s AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2), q AS (SELECT DISTINCT l_partkey AS product FROM lineitem WHERE l_partkey % 100 = 0),
r AS (SELECT product, b.l_partkey AS related, count(*) AS shared FROM q JOIN s a ON a.l_partkey = product JOIN s b ON a.l_suppkey = b.l_suppkey AND b.l_partkey <> product GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY shared DESC, related) AS rank FROM r) SELECT product, rank, related, shared FROM k WHERE rank <= 5""")
def related_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five products that share most sources with each product whose number is divisible by 100."""
    both = undirected(edges(spark, sf_dir))
    found = related(both, both.where("a LIKE 'p%'").where(F.substring("a", 2, 20).cast("long") % 100 == 0).select(F.col("a").alias("node")).distinct())
    number = lambda c: F.substring(c, 2, 20).cast("long")
    rank = F.row_number().over(Window.partitionBy("product").orderBy(F.desc("shared"), "related"))
    return found.select(number("node").alias("product"), number("other").alias("related"), "shared").withColumn("rank", rank).where("rank <= 5").select("product", "rank", "related", "shared")


@query("""WITH s AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem) SELECT l_returnflag AS edge_type, 'p' || l_partkey AS node, count(*) AS targets, md5(string_agg('s' || l_suppkey, ',' ORDER BY 's' || l_suppkey)) AS digest FROM s GROUP BY 1, 2""")
def typed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's targets by the type of the edge (the return flag here)."""
    s = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("node"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"), F.col("l_returnflag").alias("edge_type")).distinct()
    return s.groupBy("edge_type", "node").agg(F.count("*").alias("targets"), F.md5(F.array_join(F.sort_array(F.collect_list("target")), ",")).alias("digest"))


@query(f"""WITH {EDGES_SQL}, d AS (SELECT a, count(*) AS n FROM u GROUP BY 1), r AS (SELECT p_partkey, round(p_retailprice / 3000 + least(0.10, 0.02 * coalesce(n, 0)), 6) AS score FROM part LEFT JOIN d ON a = 'p' || p_partkey) SELECT * FROM r ORDER BY score DESC, p_partkey LIMIT 50""")
def boosted_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity plus the capped boost of a node's neighbours."""
    return _boosted(spark, sf_dir, edges(spark, sf_dir))


def _boosted(spark: SparkSession, sf_dir: str, e: DataFrame) -> DataFrame:
    d = degrees(undirected(e))
    rows = table(spark, sf_dir, "part").withColumn("node", F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).join(d, "node", "left")
    return rows.select("p_partkey", F.round(F.col("p_retailprice") / 3000 + F.least(F.lit(0.10), 0.02 * F.coalesce("degree", F.lit(0))), 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(50)


#: The names that these queries had while the others took a part of the edges.
for _name, _same in (("full_node_degrees", node_degrees), ("full_graph_statistics", graph_statistics), ("full_two_hops", two_hops), ("full_boosted_products", boosted_products)):
    alias(_name, _same)


@query("""WITH m AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(text, '(?:[A-Z][a-z]{3,}) (?:is|was|and) (?:[a-z]{4,})'))) AS triple FROM documents) SELECT triple, count(*) AS n, min(doc_id) AS first_doc FROM m GROUP BY 1""")
def relation_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, verb and object patterns, with how many documents hold each."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("(?:[A-Z][a-z]{3,}) (?:is|was|and) (?:[a-z]{4,})"), 0))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("triple")).groupBy("triple").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
