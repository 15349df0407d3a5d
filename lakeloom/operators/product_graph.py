"""A graph of products, brands, categories, questions and policies, built from chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relations with their weights, what is no category, and what makes a text a policy.
MADE_BY, BELONGS_TO, MENTIONED_WITH = ("made_by", 0.9), ("belongs_to", 0.8), ("mentioned_with", 0.4)
NO_CATEGORIES = ("product", "page")
#: Names: two to five words that each start with a capital; the first five of a chunk with more than five characters.
NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4}\b"
NAMES, NAME_CHARS = 5, 5
POLICY_KINDS, POLICY_WORDS = ("documentation", "text"), ("policy", "return", "shipping", "warranty")
POLICIES = ("return policy", "shipping policy", "warranty policy", "refund policy")
#: Characters of a question that name it, and that are its label.
QUESTION_ID, QUESTION_LABEL = 40, 60
# End of the fixed values.


def node_id(label: Column, kind: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]", "_"))


def names(content: Column) -> Column:
    """All names in a text, in order; repeated ones are repeated."""
    return F.filter(F.regexp_extract_all(content, F.lit("(?U)" + NAME), 0), lambda x: F.length(x) > NAME_CHARS)


def policy_label(content: Column) -> Column:
    """The first of the known policies that a text speaks of, with capitals; null if there is none."""
    lower = F.lower(content)
    return F.coalesce(*(F.when(lower.contains(p), F.lit(p.title())) for p in POLICIES))


def _full(chunks: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return chunks.select("chunk_id", *(text(c).alias(c) for c in ("title", "brand", "product_type", "chunk_type", "url", "content")))


def _mentions(chunks: DataFrame) -> DataFrame:
    """(chunk_id, title, i, name): the first names of each titled chunk that aren't its title."""
    rows = chunks.where("title <> ''").select("chunk_id", "title", F.posexplode(F.slice(names(F.col("content")), 1, NAMES)).alias("i", "name"))
    return rows.where(F.lower("name") != F.lower("title"))


def nodes(chunks: DataFrame) -> DataFrame:
    """(node_id, kind, label, url) of (chunk_id, title, brand, product_type, chunk_type, url, content).

    A node that several chunks have takes label and address from the last, in the
    order of ``chunk_id``; products that are only mentioned have a null address,
    and a mention after a product's own chunk takes its address away.  Chunks
    without a title have no products, brands or categories.  Nulls are empty.
    """
    c = _full(chunks)
    titled, none = c.where("title <> ''"), F.lit(None).cast("string")
    take = lambda rows, kind, label, step, url=none, name=None: rows.select(node_id(label if name is None else name, kind).alias("node_id"), F.lit(kind).alias("kind"), label.alias("label"), url.alias("url"), F.struct("chunk_id", step.alias("step"), label.alias("l")).alias("at"))
    category = (F.col("product_type") != "") & ~F.col("product_type").isin(*NO_CATEGORIES)
    told = F.array_contains(F.array(*map(F.lit, POLICY_KINDS)), F.col("chunk_type")) & F.exists(F.array(*map(F.lit, POLICY_WORDS)), lambda w: F.contains(F.lower("content"), w))
    all_nodes = (
        take(titled, "product", F.col("title"), F.lit(0), F.col("url"))
        .unionByName(take(titled.where("brand <> ''"), "brand", F.col("brand"), F.lit(1)))
        .unionByName(take(titled.where(category), "category", F.col("product_type"), F.lit(2)))
        .unionByName(take(_mentions(c), "product", F.col("name"), F.lit(3) + F.col("i")))
        .unionByName(take(c.where("chunk_type = 'faq' AND content <> ''"), "faq", F.substring("content", 1, QUESTION_LABEL), F.lit(9), name=F.substring("content", 1, QUESTION_ID)))
        .unionByName(take(c.where(told).withColumn("policy", policy_label(F.col("content"))).where("policy IS NOT NULL"), "policy", F.col("policy"), F.lit(9)))
    )
    return all_nodes.groupBy("node_id").agg(F.max_by(F.struct("kind", "label", "url"), "at").alias("x")).select("node_id", "x.kind", "x.label", "x.url")


def edges(chunks: DataFrame) -> DataFrame:
    """(source, target, relation, weight): made_by, belongs_to and mentioned_with, each pair once.

    Two products that mention each other have the direction of the first mention.
    """
    c = _full(chunks)
    titled, product = c.where("title <> ''"), node_id(F.col("title"), "product")
    category = (F.col("product_type") != "") & ~F.col("product_type").isin(*NO_CATEGORIES)
    plain = lambda rows, other, relation: rows.select(product.alias("source"), other.alias("target"), F.lit(relation[0]).alias("relation"), F.lit(relation[1]).alias("weight")).distinct()
    made = plain(titled.where("brand <> ''"), node_id(F.col("brand"), "brand"), MADE_BY)
    belongs = plain(titled.where(category), node_id(F.col("product_type"), "category"), BELONGS_TO)
    pairs = _mentions(c).select("chunk_id", "i", product.alias("source"), node_id(F.col("name"), "product").alias("target"))
    first = F.min_by(F.struct("source", "target"), F.struct("chunk_id", "i", "source", "target")).alias("x")
    mentioned = pairs.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(first)
    return made.unionByName(belongs).unionByName(mentioned.select("x.source", "x.target", F.lit(MENTIONED_WITH[0]).alias("relation"), F.lit(MENTIONED_WITH[1]).alias("weight")))
