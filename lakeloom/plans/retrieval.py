"""Vector, keyword and hybrid retrieval, and what follows a retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import vocabulary as V
from lakeloom.operators.inverted_file import build, search
from lakeloom.operators.retrieve import retrieve
from lakeloom.operators.search import bm25, hashed_vectors, merge_hits, postings, reciprocal_rank_fusion
from lakeloom.operators.stemming import stemmed
from lakeloom.operators.vector import cosine_top_k
from lakeloom.plans.registry import query, table
from lakeloom.storage import stored


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, rows): the stated query set is every 100th row, against all rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return rows.where("id % 100 = 0"), rows


PAIRS_SQL = """p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, q.label AS q_label, e.label AS label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)"""


@query(f"WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p) SELECT query_id, rank, id, similarity FROM r WHERE rank <= 10")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar rows of every query."""
    return cosine_top_k(*vectors(spark, sf_dir), k=10)


@query()
def indexed_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar rows of every query among its 40 nearest of 100 k-means lists."""
    asked, rows = vectors(spark, sf_dir)
    return search(build(rows), asked, k=10, probes=40)


@query(f"WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p) SELECT query_id, rank, id, similarity FROM r WHERE rank <= 10")
def all_lists_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all lists opened: exact."""
    asked, rows = vectors(spark, sf_dir)
    return search(build(rows, lists=16, rounds=3), asked, k=10, probes=16)


@query(f"WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p WHERE similarity >= 0.35) SELECT query_id, rank, id, similarity FROM r WHERE rank <= 20")
def product_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to twenty rows above a similarity threshold."""
    return cosine_top_k(*vectors(spark, sf_dir), k=20, threshold=0.35)


@query(f"WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p WHERE label = q_label AND similarity >= 0.3) SELECT query_id, rank, id, similarity FROM r WHERE rank = 1")
def semantic_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached row that may answer a query: same entities (label), similar enough, the best of them."""
    return cosine_top_k(*vectors(spark, sf_dir), k=1, threshold=0.3, guard="label")


BM25_SQL = """t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t),
i AS (SELECT id, len AS length, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM t) GROUP BY 1, 2, 3), a AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
d AS (SELECT term, count(*) AS df FROM i GROUP BY 1), b AS (SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 5) AS score
FROM a JOIN i USING (term) JOIN d USING (term), s GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b)"""


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {BM25_SQL} SELECT query_id, rank, id, score FROM k WHERE rank <= 5")
def keyword_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the documents for every benchmark item."""
    return bm25(benchmark_queries(spark, sf_dir), table(spark, sf_dir, "documents"), 5)


#: Hashed term counts of questions and documents, and their cosine.
HASHED_SQL = """hd AS (SELECT doc_id AS id, left(md5(t), 2) AS b, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents) GROUP BY 1, 2),
hq AS (SELECT item_id AS query_id, left(md5(t), 2) AS b, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark) GROUP BY 1, 2),
ln AS (SELECT id, sqrt(sum(n * n)) AS x FROM hd GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(n * n)) AS x FROM hq GROUP BY 1),
hc AS (SELECT query_id, id, round(s / ln.x / qn.x, 6) AS similarity FROM (SELECT query_id, id, CAST(sum(hd.n * hq.n) AS DOUBLE) AS s FROM hd JOIN hq USING (b) GROUP BY 1, 2) JOIN ln USING (id) JOIN qn USING (query_id)),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM hc)"""


def hashed_hits(spark: SparkSession, sf_dir: str, k: int, threshold: float = -1.0) -> DataFrame:
    """The documents nearest to each benchmark item by hashed terms; ids of items and documents are apart."""
    asked = hashed_vectors(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("id", -1 - F.col("id"))  # an item never is a document
    return cosine_top_k(asked, hashed_vectors(table(spark, sf_dir, "documents"), "doc_id", "text"), k, threshold).withColumn("query_id", -1 - F.col("query_id"))


@query(f"""WITH {BM25_SQL}, {HASHED_SQL}, f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, id, rank FROM k WHERE rank <= 20 UNION ALL SELECT query_id, id, rank FROM v WHERE rank <= 20) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) SELECT query_id, rank, id, CAST(score AS DOUBLE) AS score FROM r WHERE rank <= 5""")
def fused_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword ranking and the vector ranking of the documents, fused by reciprocal ranks."""
    found = bm25(benchmark_queries(spark, sf_dir), table(spark, sf_dir, "documents"), 20)
    return reciprocal_rank_fusion([found, hashed_hits(spark, sf_dir, 20)], 5)


AND_SQL = """n AS (SELECT query_id, count(*) AS n FROM a GROUP BY 1), every AS (SELECT query_id, id FROM a JOIN i USING (term) JOIN n USING (query_id) GROUP BY 1, 2 HAVING count(*) = any_value(n.n)),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM b JOIN every USING (query_id, id))"""


@query(f"WITH {BM25_SQL}, {AND_SQL} SELECT query_id, place AS rank, id, score FROM w WHERE place <= 10")
def all_terms_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents that hold every term of a benchmark item."""
    return bm25(benchmark_queries(spark, sf_dir), table(spark, sf_dir, "documents"), 10, every_term=True)


def stemmed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as stems, written once, as a search reads them twice."""
    return stored(stemmed(table(spark, sf_dir, "documents"), "doc_id", "text"), "stems")


@query()
def stemmed_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents that hold a form of every word of a benchmark item, stop words aside."""
    return bm25(stemmed(benchmark_queries(spark, sf_dir), "query_id", "text"), stemmed_documents(spark, sf_dir), 10, every_term=True)


@query()
def looked_up_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents that hold a form of each of an item's first four words."""
    return bm25(stemmed(benchmark_queries(spark, sf_dir), "query_id", "text", first=4), stemmed_documents(spark, sf_dir), 3, every_term=True)


@query(f"""WITH {BM25_SQL}, {AND_SQL}, {HASHED_SQL}, x AS (SELECT query_id, id, similarity, 'vector' AS channel FROM v WHERE similarity >= 0.35 AND rank <= 5), y AS (SELECT query_id, id, round(score / (score + 10), 6) AS similarity, 'keyword' AS channel FROM w WHERE place <= 10),
m AS (SELECT query_id, count(*) AS more FROM y GROUP BY 1), z AS (SELECT * FROM x UNION ALL SELECT * FROM y ANTI JOIN x USING (query_id, id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM z)
SELECT query_id, rank, id, similarity, channel FROM r LEFT JOIN m USING (query_id) WHERE rank <= 5 + coalesce(more, 0)""")
def hybrid_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: five vector hits above the threshold and the keyword hits that they lack, by similarity.

    A keyword hit holds every term of the question; its score s counts as s / (s + 10).
    """
    score = F.col("score")
    worded = bm25(benchmark_queries(spark, sf_dir), table(spark, sf_dir, "documents"), 10, every_term=True).withColumn("similarity", F.round(score / (score + 10), 6))
    return merge_hits(hashed_hits(spark, sf_dir, 5, V.SIMILARITY_THRESHOLD), worded, 5)


@query("""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1""")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequency of every term."""
    return postings(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@query(f"""WITH {BM25_SQL}, p AS (SELECT query_id, source FROM k JOIN documents ON doc_id = id WHERE rank = 1) SELECT query_id, doc_id AS id, CAST(0.95 AS DOUBLE) AS score FROM p JOIN documents USING (source)""")
def pinned_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of the source that holds a query's best hit, at a fixed score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    best = bm25(benchmark_queries(spark, sf_dir), docs, 1).select("query_id", F.col("id").alias("doc_id"))
    sources = best.join(docs.select("doc_id", "source"), "doc_id").select("query_id", "source")
    return sources.join(docs.select("source", F.col("doc_id").alias("id")), "source").select("query_id", "id", F.lit(0.95).alias("score"))


@query("""SELECT conv_id, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of one place as one text, in order."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "text")))  # a conversation's turns are few
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")).alias("digest"))


@query("""WITH n AS (SELECT *, trim(regexp_replace(lower(p_type), '\\s*[-—(].*$', '')) AS title FROM part) SELECT title, min(p_partkey) AS position, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS kept, max(p_retailprice) AS similarity FROM n GROUP BY 1""")
def deduplicated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit per title (cut at the first dash or bracket): the most similar, at the first one's place."""
    title = F.trim(F.regexp_replace(F.lower("p_type"), r"\s*[-—(].*$", ""))
    best = F.max(F.struct("p_retailprice", (-F.col("p_partkey")).alias("k"))).alias("b")
    return table(spark, sf_dir, "part").groupBy(title.alias("title")).agg(F.min("p_partkey").alias("position"), best).select("title", "position", (-F.col("b.k")).alias("kept"), F.col("b.p_retailprice").alias("similarity"))


@query("""WITH d AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY 1), r AS (SELECT p_partkey, round(0.55 * (p_retailprice / 3000) + 0.35 * (p_size / 50) + 0.10 * least(0.10, 0.02 * coalesce(degree, 0)), 6) AS score FROM part LEFT JOIN d ON l_partkey = p_partkey)
SELECT p_partkey, score FROM r ORDER BY score DESC, p_partkey LIMIT 20""")
def ranked_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance, completeness and the (capped) boost of the product's neighbours."""
    degree = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("degree"))
    score = 0.55 * (F.col("p_retailprice") / 3000) + 0.35 * (F.col("p_size") / 50) + 0.10 * F.least(F.lit(0.10), 0.02 * F.coalesce("degree", F.lit(0)))
    return table(spark, sf_dir, "part").join(degree, "p_partkey", "left").select("p_partkey", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(20)


@query("""SELECT conv_id, turn, md5(conv_id || ':' || lower(trim(text))) AS cache_key FROM conversations""")
def response_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of exact answers."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.lower(F.trim("text")))).alias("cache_key"))


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations), l AS (SELECT conv_id, arg_max(w, turn) AS lw, max(turn) AS lt FROM w GROUP BY 1),
r AS (SELECT w.conv_id, turn, CAST(len(list_intersect(w, lw)) AS INTEGER) AS overlap, row_number() OVER (PARTITION BY w.conv_id ORDER BY len(list_intersect(w, lw)) DESC, turn DESC) AS rank FROM w JOIN l USING (conv_id) WHERE turn < lt) SELECT conv_id, turn, overlap FROM r WHERE rank <= 3""")
def relevant_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three earlier turns that share most words with a conversation's last one, newest first among equals."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)).alias("w"))
    last = words.groupBy("conv_id").agg(F.max_by("w", "turn").alias("lw"), F.max("turn").alias("lt"))
    scored = words.join(last, "conv_id").where("turn < lt").select("conv_id", "turn", F.size(F.array_intersect("w", "lw")).alias("overlap"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("overlap"), F.desc("turn")))
    return scored.withColumn("rank", rank).where("rank <= 3").drop("rank")


@query("""WITH n AS (SELECT page_id, url, rtrim(regexp_replace(url, '[?#].*$', ''), '/') AS canonical, length(html) AS size FROM pages) SELECT canonical, count(*) AS pages, arg_max(page_id, (size, -page_id)) AS richest FROM n GROUP BY 1""")
def pages_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages grouped by address without query, fragment and trailing slash; the largest of each."""
    canonical = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", "")
    best = F.max(F.struct(F.length("html").alias("s"), (-F.col("page_id")).alias("k"))).alias("b")
    return table(spark, sf_dir, "pages").groupBy(canonical.alias("canonical")).agg(F.count("*").alias("pages"), best).select("canonical", "pages", (-F.col("b.k")).alias("richest"))


@query("""SELECT md5(text) AS digest, min(doc_id) AS kept, count(*) - 1 AS skipped FROM documents GROUP BY 1""")
def unchanged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content was seen before are skipped."""
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("kept"), (F.count("*") - 1).alias("skipped"))


def retrievable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as chunks: four to a source, every other source a product's, a fiftieth of the rows about places."""
    at, place = F.col("doc_id"), F.col("doc_id") % 50 == 0
    source = F.when(place, F.concat(F.lit("store-location/"), at % 7)).otherwise(F.concat_ws("/", "source", F.floor(at / 4)))
    title = F.array_join(F.slice(F.split("text", " "), 1, 1), " ")
    return table(spark, sf_dir, "documents").select(at.alias("id"), source.alias("source"), (at % 4).cast("int").alias("chunk_index"), title.alias("title"), (at % 8 < 4).alias("product"), F.col("text").alias("content"))


def flagged_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items, a fifth of them asking for a place and a fifth for a price."""
    more = F.when(F.col("item_id") % 5 == 0, " store").when(F.col("item_id") % 5 == 1, " price").otherwise("")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", more).alias("text"))


@query(f"""WITH {BM25_SQL}, {AND_SQL}, {HASHED_SQL}, ch AS (SELECT doc_id AS id, CASE WHEN doc_id % 50 = 0 THEN 'store-location/' || (doc_id % 7) ELSE source || '/' || (doc_id // 4) END AS source, doc_id % 4 AS chunk_index, trim(regexp_replace(lower(trim(split_part(text, ' ', 1))), '\\s*[-—(].*$', '')) AS title, doc_id % 8 < 4 AS product, text AS content FROM documents),
near AS (SELECT query_id, rank, id, similarity FROM v WHERE similarity >= 0.35 AND rank <= 5), worded AS (SELECT query_id, place AS rank, id, round(score / (score + 10), 6) AS similarity FROM w WHERE place <= 10),
asked AS (SELECT item_id AS query_id, item_id % 5 = 0 OR list_has_any(regexp_extract_all(lower(text), '[a-z]+'), ['store', 'location', 'shop', 'branch', 'sylhet', 'chittagong', 'ctg', 'narayanganj', 'mirpur', 'gulshan', 'dhanmondi', 'bashundhara', 'wari']) AS place, item_id % 5 = 1 OR regexp_matches(text, '(?i)\\b(how much|price|cost|available|in stock|availability)\\b') AS one_field FROM benchmark),
shelf AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY chunk_index, id) AS at_place FROM ch), held AS (SELECT * FROM ch WHERE contains(lower(source), 'store-location') ORDER BY chunk_index, id LIMIT 20),
one AS (SELECT arg_min(id, (chunk_index, id)) AS id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, id) AS content FROM held),
al AS (SELECT query_id, one.id, 0.95 AS similarity, 'place' AS channel, 0 AS step, 1 AS pos FROM asked CROSS JOIN one WHERE place AND one.id IS NOT NULL UNION ALL
SELECT n.query_id, s.id, 0.95, 'pinned', 1, at_place FROM near n JOIN ch ON ch.id = n.id AND n.rank = 1 AND product AND source <> '' JOIN shelf s ON s.source = ch.source AND at_place <= 20 UNION ALL SELECT query_id, id, similarity, 'vector', 2, rank FROM near UNION ALL SELECT query_id, id, similarity, 'keyword', 3, rank FROM worded),
kp AS (SELECT al.*, title, one_field FROM al JOIN asked USING (query_id) JOIN ch ON ch.id = al.id WHERE NOT contains(source, 'store-location') OR NOT place OR step IN (0, 3) OR NOT EXISTS (SELECT 1 FROM one WHERE one.id IS NOT NULL)),
un AS (SELECT * FROM kp QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY step, pos) = 1), mm AS (SELECT query_id, count(*) AS more FROM worded GROUP BY 1),
od AS (SELECT un.*, more, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN more > 0 THEN -similarity ELSE 0 END, step, pos) AS n FROM un LEFT JOIN mm USING (query_id)),
dd AS (SELECT query_id, min(n) AS n, arg_min(id, (-similarity, n)) AS id, arg_min(similarity, (-similarity, n)) AS similarity, arg_min(channel, (-similarity, n)) AS channel FROM od WHERE more IS NULL OR n <= 5 + more GROUP BY query_id, CASE WHEN one_field AND title <> '' THEN 't' || title ELSE 'i' || id END)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n) AS INTEGER) AS rank, dd.id, CAST(similarity AS DOUBLE) AS similarity, channel, CASE WHEN channel = 'place' THEN md5(one.content) END AS digest FROM dd CROSS JOIN one""")
def retrieved_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that each benchmark item retrieves: five vector hits, its best product's chunks, places as one, keyword hits, one row a title."""
    score, questions = F.col("score"), flagged_questions(spark, sf_dir)
    worded = bm25(benchmark_queries(spark, sf_dir), table(spark, sf_dir, "documents"), 10, every_term=True).select("query_id", "rank", "id", F.round(score / (score + 10), 6).alias("similarity"))
    found = retrieve(questions, hashed_hits(spark, sf_dir, 5, V.SIMILARITY_THRESHOLD), worded, retrievable_chunks(spark, sf_dir), 5)
    return found.select("query_id", "rank", "id", "similarity", "channel", F.md5("content").alias("digest"))
