"""Context building around chunks, record texts and their parsing, and small set work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import planning as P
from lakeloom.operators.expansion import expanded_chunks
from lakeloom.operators.product_graph import BELONGS_TO, MADE_BY, MENTIONED_WITH, NAME, NAME_CHARS, NAMES, edges, nodes
from lakeloom.operators.sharing import sharing_counts
from lakeloom.plans.registry import alias, query, table
from lakeloom.plans.texts import any_sql


@query("""SELECT doc_id, source, md5(coalesce(string_agg(md5(text), chr(10)) OVER (PARTITION BY source ORDER BY doc_id RANGE BETWEEN 40 PRECEDING AND 40 FOLLOWING), '')) AS digest FROM documents""")
def sibling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the digests of each whole chunk and its neighbours in the source (ids at most 40 away), in order.

    A source is split into blocks of 1,000 ids, and the rows near a border are
    also in the block beyond it.
    """
    block = lambda shift: F.floor((F.col("doc_id") + shift) / 1000)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    dealt = docs.withColumn("block", F.explode(F.array_distinct(F.array(block(-40), block(0), block(40)))))
    near = F.collect_list(F.when(F.col("h").isNotNull(), F.struct("doc_id", "h"))).over(Window.partitionBy("source", "block").orderBy("doc_id").rangeBetween(-40, 40))
    own = dealt.select("doc_id", "source", "block", near.alias("near")).where(F.col("block").eqNullSafe(block(0)))
    return own.select("doc_id", "source", F.md5(F.array_join(F.transform(F.sort_array("near"), lambda x: x["h"]), "\n")).alias("digest"))


alias("whole_sibling_windows", sibling_windows)


@query("""SELECT c.doc_id, p.doc_id AS parent_id, p.n_chars AS parent_chars FROM documents c JOIN documents p ON p.source = c.source AND p.doc_id = c.doc_id - c.doc_id % 40 WHERE c.n_chars < 400""")
def parent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent of every short chunk: same source, the parent's index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    parents = docs.select("source", F.col("doc_id").alias("parent_id"), F.col("n_chars").alias("parent_chars"))
    short = docs.where("n_chars < 400").withColumn("parent_id", F.col("doc_id") - F.col("doc_id") % 40)
    return short.join(parents, ["source", "parent_id"]).select("doc_id", "parent_id", "parent_chars")


@query("""WITH r AS (SELECT conv_id, turn, role, length(text) AS n, sum(length(text) + 30) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations)
SELECT conv_id, count(*) AS parts, CAST(sum(n) AS BIGINT) AS chars, string_agg(role, ',' ORDER BY turn) AS sources FROM r WHERE used <= 1200 GROUP BY 1""")
def context_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fits a context before the first part that overflows it."""
    used = F.sum(F.length("text") + 30).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    kept = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"), used.alias("used")).where("used <= 1200")
    roles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",")
    return kept.groupBy("conv_id").agg(F.count("*").alias("parts"), F.sum("n").alias("chars"), roles.alias("sources"))


_MARKS = " ".join(f"WHEN {any_sql('lower(html)', m)} THEN '{n}'" for n, m in P.PLATFORMS)


@query(f"SELECT page_id, CASE {_MARKS} ELSE 'generic' END AS platform, regexp_extract(html, '(?i)<meta[^>]*charset=\"?([a-z0-9-]+)', 1) AS charset FROM pages")
def platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system that made a page, by its marks."""
    return table(spark, sf_dir, "pages").select("page_id", P.platform(F.col("html")).alias("platform"), F.regexp_extract("html", '(?i)<meta[^>]*charset="?([a-z0-9-]+)', 1).alias("charset"))


RECORD_SQL = """v AS (SELECT l_partkey, l_suppkey, max(l_extendedprice) AS price, bool_or(l_returnflag <> 'R') AS available FROM lineitem GROUP BY 1, 2)"""


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, content): product records as labelled text with a block of variants."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("price"), F.bool_or(F.col("l_returnflag") != "R").alias("available"))
    line = F.format_string("  - S%d: %s BDT, %s, SKU: SK%d-%d", "l_suppkey", F.format_number("price", 2), F.when(F.col("available"), "In Stock").otherwise("Out of Stock"), "l_partkey", "l_suppkey")
    block = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_suppkey", line.alias("x")))), lambda s: s["x"]), "\n").alias("variants"))
    head = F.concat_ws("\n", F.concat(F.lit("Product: "), "p_name"), F.concat(F.lit("Brand: "), "p_brand"), F.concat(F.lit("Type: "), "p_type"), F.concat(F.lit("Price: "), F.format_number("p_retailprice", 2), F.lit(" BDT")))
    return table(spark, sf_dir, "part").join(block, "p_partkey").select("p_partkey", F.concat(head, F.lit("\nVariants:\n"), F.col("variants")).alias("content"))


@query(f"""WITH {RECORD_SQL} SELECT p_partkey, p_name AS title, p_brand AS brand, p_type AS kind, round(p_retailprice, 2) AS price, count(*) AS n_variants, count(*) FILTER (WHERE available) AS in_stock, round(min(round(v.price, 2)), 2) AS lowest
FROM part JOIN v ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4, 5""")
def parsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record texts parsed back into fields and variants."""
    text = F.col("content")
    rows = record_texts(spark, sf_dir).select("p_partkey", P.field(text, "Product").alias("title"), P.field(text, "Brand").alias("brand"), P.field(text, "Type").alias("kind"), P.field(text, "Price").alias("p"), P.variants(text).alias("v"))
    price = F.regexp_replace(F.regexp_extract("p", r"[\d,]+\.?\d*", 0), ",", "").cast("double")
    lowest = F.array_min(F.transform("v", lambda x: x["price"]))
    return rows.select("p_partkey", "title", "brand", "kind", price.alias("price"), F.size("v").cast("long").alias("n_variants"), F.size(F.filter("v", lambda x: x["available"])).cast("long").alias("in_stock"), lowest.alias("lowest"))


@query("""WITH s AS (SELECT l_partkey, list(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'N') AS a, list(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY 1)
SELECT l_partkey, CAST(len(list_intersect(coalesce(a, []), coalesce(b, []))) AS INTEGER) AS both_sides, CAST(len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS INTEGER) AS only_first, CAST(len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS INTEGER) AS only_second FROM s""")
def variant_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of two snapshots: in both, in the first alone, in the second alone."""
    of = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_suppkey")))
    sides = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(of("N").alias("a"), of("R").alias("b"))
    return sides.select("l_partkey", F.size(F.array_intersect("a", "b")).alias("both_sides"), F.size(F.array_except("a", "b")).alias("only_first"), F.size(F.array_except("b", "a")).alias("only_second"))


@query("""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
SELECT item_id, count(*) AS documents FROM q JOIN d ON len(list_intersect(q.w, d.w)) > 0 GROUP BY 1""")
def documents_sharing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents share a word, of any length, with each benchmark item."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return sharing_counts(asked, table(spark, sf_dir, "documents")).withColumnRenamed("id", "item_id")


# Letters that aren't ASCII become digits first, as DuckDB ends words at them.
_PLAIN = "regexp_replace({0}, '[^\\x00-\\x7F\\P{{L}}]|[^\\x00-\\x7F\\P{{N}}]', '0', 'g')"
_NAMES = f"list_filter(regexp_extract_all({_PLAIN.format('text')}, '{NAME}'), lambda x: length(x) > {NAME_CHARS})"


@query("""WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS entity FROM documents)
SELECT a.entity AS a, b.entity AS b, count(*) AS weight FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) > 1""")
def co_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between all names that several documents mention together, however short or frequent.

    Documents with the same names are counted first; a document's pairs come
    from its own list, so that nothing is joined on a name.
    """
    found = F.sort_array(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0)))
    classes = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(found.alias("names")).where("size(names) > 1").groupBy("names").agg(F.count("*").alias("n"))
    first = classes.select("names", "n", F.posexplode("names").alias("i", "a"))
    pairs = first.select("n", "a", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("weight")).where("weight > 1")


alias("all_co_mentions", co_mentions)


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as chunks: a sixth has each kind, titles are their first words, sources and languages stand for brands and categories."""
    kind = F.element_at(F.array(*map(F.lit, ("faq", "documentation", "text", "product", "table", "text"))), (F.col("doc_id") % 6 + 1).cast("int"))
    title = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.array_join(F.slice(F.split("text", " "), 1, 2), " "))
    category = F.when(F.col("doc_id") % 5 == 0, "page").otherwise(F.col("lang"))
    content = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" Our Return Policy: Red Boxer Combo, Apache License."))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), title.alias("title"), F.col("source").alias("brand"), category.alias("product_type"), kind.alias("chunk_type"), F.concat_ws("/", F.lit("doc"), "doc_id").alias("url"), content.alias("content"))


_ID = lambda x, kind: f"'{kind}:' || regexp_replace(lower(trim({x})), '[^a-z0-9]', '_', 'g')"
CHUNKS_SQL = f"""c AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE array_to_string(string_split(text, ' ')[1:2], ' ') END AS title, source AS brand, CASE WHEN doc_id % 5 = 0 THEN 'page' ELSE lang END AS product_type,
['faq', 'documentation', 'text', 'product', 'table', 'text'][doc_id % 6 + 1] AS chunk_type, 'doc/' || doc_id AS url, CASE WHEN doc_id % 7 = 0 THEN text || ' Our Return Policy: Red Boxer Combo, Apache License.' ELSE text END AS text FROM documents),
m AS (SELECT chunk_id, title, unnest(ns) AS name, unnest(range(len(ns))) AS i FROM (SELECT chunk_id, title, {_NAMES}[1:{NAMES}] AS ns FROM c WHERE title <> '')), mm AS (SELECT * FROM m WHERE lower(name) <> lower(title))"""


@query(f"""WITH {CHUNKS_SQL}, n AS (SELECT {_ID("title", "product")} AS node_id, 'product' AS kind, title AS label, url, chunk_id, 0 AS step FROM c WHERE title <> '' UNION ALL SELECT {_ID("brand", "brand")}, 'brand', brand, NULL, chunk_id, 1 FROM c WHERE title <> '' AND brand <> ''
UNION ALL SELECT {_ID("product_type", "category")}, 'category', product_type, NULL, chunk_id, 2 FROM c WHERE title <> '' AND product_type NOT IN ('', 'product', 'page') UNION ALL SELECT {_ID("name", "product")}, 'product', name, NULL, chunk_id, 3 + i FROM mm
UNION ALL SELECT {_ID("left(text, 40)", "faq")}, 'faq', left(text, 60), NULL, chunk_id, 9 FROM c WHERE chunk_type = 'faq' AND text <> ''
UNION ALL SELECT {_ID("p", "policy")}, 'policy', p, NULL, chunk_id, 9 FROM (SELECT *, CASE WHEN contains(lower(text), 'return policy') THEN 'Return Policy' WHEN contains(lower(text), 'shipping policy') THEN 'Shipping Policy' WHEN contains(lower(text), 'warranty policy') THEN 'Warranty Policy' WHEN contains(lower(text), 'refund policy') THEN 'Refund Policy' END AS p FROM c WHERE chunk_type IN ('documentation', 'text')) WHERE p IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY chunk_id DESC, step DESC, label DESC) AS place FROM n) SELECT node_id, kind, label, url FROM r WHERE place = 1""")
def chunk_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products, brands, categories, questions and policies of the documents' chunks."""
    return nodes(document_chunks(spark, sf_dir))


@query(f"""WITH {CHUNKS_SQL}, k AS (SELECT {_ID("title", "product")} AS source, {_ID("name", "product")} AS target, chunk_id, i FROM mm), r AS (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY chunk_id, i, source, target) AS place FROM k)
SELECT DISTINCT {_ID("title", "product")} AS source, {_ID("brand", "brand")} AS target, '{MADE_BY[0]}' AS relation, CAST({MADE_BY[1]} AS DOUBLE) AS weight FROM c WHERE title <> '' AND brand <> ''
UNION ALL SELECT DISTINCT {_ID("title", "product")}, {_ID("product_type", "category")}, '{BELONGS_TO[0]}', CAST({BELONGS_TO[1]} AS DOUBLE) FROM c WHERE title <> '' AND product_type NOT IN ('', 'product', 'page')
UNION ALL SELECT source, target, '{MENTIONED_WITH[0]}', CAST({MENTIONED_WITH[1]} AS DOUBLE) FROM r WHERE place = 1""")
def chunk_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What joins them: brands, categories and mentions."""
    return edges(document_chunks(spark, sf_dir))


@query("""WITH c AS (SELECT doc_id AS id, source || '/' || (doc_id // 10) AS source, doc_id % 10 AS chunk_index, ['text', 'table', 'faq', 'text', 'product'][doc_id % 5 + 1] AS kind, text AS content FROM documents),
a AS (SELECT * FROM c WHERE length(content) < 200 OR kind IN ('table', 'faq', 'documentation')), w AS (SELECT a.id, string_agg(c.content, chr(10) || chr(10) ORDER BY c.chunk_index, c.id) AS whole FROM a JOIN c ON c.source = a.source AND c.chunk_index BETWEEN a.chunk_index - 1 AND a.chunk_index + 1 GROUP BY 1)
SELECT c.id, md5(CASE WHEN length(whole) > length(content) THEN whole ELSE content END) AS digest, coalesce(length(whole) > length(content), false) AS expanded FROM c LEFT JOIN w USING (id)""")
def chunks_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as chunks, ten to a source, those that are short or fragments with their neighbours."""
    at, kinds = F.col("doc_id"), F.array(*map(F.lit, ("text", "table", "faq", "text", "product")))
    chunks = table(spark, sf_dir, "documents").select(at.alias("id"), F.concat_ws("/", "source", F.floor(at / 10)).alias("source"), (at % 10).alias("chunk_index"), F.get(kinds, (at % 5).cast("int")).alias("kind"), F.col("text").alias("content"))
    return expanded_chunks(chunks).select("id", F.md5("content").alias("digest"), "expanded")
