"""Pages and documents: extraction, cleaning, chunking and synchronising."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions import classify as C
from lakeloom.functions import vocabulary as V
from lakeloom.operators.chunking import fixed_chunks, semantic_chunks, typed_chunks
from lakeloom.operators.html import extract_pages, first_tag, visible_text
from lakeloom.plans.registry import query, table
from lakeloom.plans.texts import any_sql, count_sql, s


def unescape_sql(x: str) -> str:
    for a, b in V.ENTITIES.items():
        x = f"replace({x}, {s(a)}, {s(b)})"
    return x


def tag_sql(tag: str) -> str:
    return f"trim({unescape_sql(f'''regexp_replace(regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', '', 'g')''')})"


VISIBLE_SQL = "trim(regexp_replace(" + unescape_sql("regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"


@query(f"""SELECT page_id, {tag_sql("title")} AS title, {tag_sql("h1")} AS heading, CAST(len(regexp_extract_all(html, '(?i)<p[ >]')) AS INTEGER) AS paragraphs, CAST(len(regexp_extract_all(html, '(?i)<a [^>]*href')) AS INTEGER) AS links,
regexp_extract(html, '(?i)<html[^>]* lang="([^"]*)"', 1) AS lang FROM pages""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, heading, language and counts, by patterns."""
    html = F.col("html")
    n = lambda p: F.regexp_count(html, F.lit(p)).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", first_tag(html, "title").alias("title"), first_tag(html, "h1").alias("heading"), n("(?i)<p[ >]").alias("paragraphs"), n("(?i)<a [^>]*href").alias("links"), F.regexp_extract(html, '(?i)<html[^>]* lang="([^"]*)"', 1).alias("lang"))


@query(f"SELECT page_id, md5({VISIBLE_SQL}) AS digest, CAST(length({VISIBLE_SQL}) AS INTEGER) AS chars FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and length of each page's visible text."""
    text = visible_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("digest"), F.length(text).alias("chars"))


@query()
def extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, headings, main text, tables and product data by a parser."""
    return extract_pages(table(spark, sf_dir, "pages"))


_U = "lower(url)"
PRIORITY_SQL = "CASE " + " ".join(f"WHEN contains({_U}, '/{k}/') OR ends_with({_U}, '/{k}') THEN {v}" for k, v in V.ADDRESS_PRIORITY.items()) + f" ELSE {V.DEFAULT_PRIORITY} END"
CANONICAL_SQL = f"""c AS (SELECT page_id, url, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages), h AS (SELECT *, regexp_extract(bare, '^([^?]*)', 1) AS head, CASE WHEN contains(bare, '?') THEN regexp_extract(bare, '\\?(.*)$', 1) ELSE '' END AS tail FROM c),
o AS (SELECT *, regexp_extract(head, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1) AS origin FROM h), k AS (SELECT *, regexp_replace(head[len(origin) + 1 :], '/+$', '') AS path,
array_to_string(list_sort(list_filter(string_split(tail, '&'), lambda x: contains(x, '=') AND NOT ends_with(x, '=') AND NOT list_contains([{", ".join(map(s, V.TRACKING_PARAMETERS))}], lower(split_part(x, '=', 1))))), '&') AS query FROM o),
n AS (SELECT page_id, url, lower(origin) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM k)"""


@query(f"WITH {CANONICAL_SQL} SELECT page_id, canonical, md5(canonical) AS address_hash, {PRIORITY_SQL} AS priority, {any_sql(_U, V.SKIPPED_ADDRESSES)} AS skipped FROM n")
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical address, its hash, crawl priority and whether it is skipped."""
    url = F.col("url")
    rows = table(spark, sf_dir, "pages").select("page_id", "url", C.canonical_address(url).alias("canonical"))
    return rows.select("page_id", "canonical", F.md5("canonical").alias("address_hash"), C.address_priority(url).alias("priority"), C.skipped_address(url).alias("skipped"))


@query(f"""WITH {CANONICAL_SQL}, d AS (SELECT canonical, min(page_id) AS page_id, min({PRIORITY_SQL}) AS priority FROM n WHERE NOT {any_sql(_U, V.SKIPPED_ADDRESSES)} GROUP BY 1) SELECT * FROM d ORDER BY priority, canonical LIMIT 20""")
def frontier_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next twenty addresses to fetch, each once."""
    url = F.col("url")
    rows = table(spark, sf_dir, "pages").where(~C.skipped_address(url)).select("page_id", C.canonical_address(url).alias("canonical"), C.address_priority(url).alias("priority"))
    return rows.groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.min("priority").alias("priority")).orderBy("priority", "canonical").limit(20)


_H = "lower(html)"
_PRICED = f"({count_sql(_H, V.PRICING_SIGNALS)} >= 2 OR contains({_U}, 'pricing') OR contains({_U}, 'plans'))"


@query(f"SELECT page_id, {count_sql(_H, V.PRODUCT_SIGNALS)} AS product_hits, {count_sql(_H, V.PRICING_SIGNALS)} AS pricing_hits, CASE WHEN {_PRICED} THEN 'pricing' WHEN {count_sql(_H, V.PRODUCT_SIGNALS)} >= 2 THEN 'product' ELSE 'general' END AS kind FROM pages")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product and pricing pages by their signals."""
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(k) for k, c in C.page_kind(F.col("html"), F.col("url")).items()])


@query(f"""WITH t AS (SELECT page_id, {VISIBLE_SQL} AS v, html FROM pages) SELECT page_id, round(CAST(CASE WHEN length(v) < 100 THEN 0.1 ELSE greatest(0.0, least(1.0, 1.0 - CASE WHEN contains(lower(html), 'faq') AND NOT contains(lower(v), 'faq') THEN 0.15 ELSE 0 END - CASE WHEN contains(html, '<table') AND NOT contains(v, '|') THEN 0.1 ELSE 0 END)) END AS DOUBLE), 4) + 0.0 AS quality FROM t""")
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the text of a page stands for its HTML."""
    text, html = visible_text(F.col("html")), F.col("html")
    rows = table(spark, sf_dir, "pages").select("page_id", text.alias("v"), "html")
    faq = F.when(F.contains(F.lower(html), F.lit("faq")) & ~F.contains(F.lower("v"), F.lit("faq")), 0.15).otherwise(0.0)
    tables = F.when(F.contains(html, F.lit("<table")) & ~F.contains(F.col("v"), F.lit("|")), 0.1).otherwise(0.0)
    score = F.when(F.length("v") < 100, 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - faq - tables)))
    return rows.select("page_id", F.round(score, 4).alias("quality"))


@query("""WITH n AS (SELECT doc_id, text, unnest(range(0, CAST(floor(greatest(0, length(text) - 201) / 800) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(substring(text, CAST(i * 800 + 1 AS BIGINT), 1000)) AS digest FROM n""")
def fixed_width_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1000 characters with an overlap of 200."""
    return fixed_chunks(table(spark, sf_dir, "documents"), 1000, 200).select("doc_id", "chunk_index", F.md5("chunk").alias("digest"))


@query()
def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by headings, rules and sentences, with their kind."""
    return semantic_chunks(table(spark, sf_dir, "documents")).withColumn("kind", C.chunk_type(F.col("chunk")))


@query()
def sized_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks sized by their kind, with their parents and a header, ready to be embedded."""
    header = F.concat(F.lit("Source: "), F.coalesce("source", F.lit("")), F.lit("\nType: "), "kind")
    return typed_chunks(table(spark, sf_dir, "documents"), "source").select("doc_id", "chunk_index", "total_chunks", "kind", "parent_index", F.length("chunk").alias("n_chars"), F.md5(F.concat(header, F.lit("\n\n"), "chunk")).alias("digest"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)^Q:\\s*[^\\n]+') THEN 'faq' WHEN regexp_matches(text, '[^\\n]\\|[^\\n]') THEN 'table' WHEN regexp_matches(text, 'Price:|SKU:|Brand:|Availability:') THEN 'product_spec' WHEN regexp_matches(text, '#{1,6}\\s') THEN 'documentation' ELSE 'text' END AS kind,
'Source: ' || source || chr(10) || 'Language: ' || lang AS header FROM documents""")
def chunk_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of a chunk and the header that is embedded with it."""
    header = F.concat_ws("\n", F.concat(F.lit("Source: "), "source"), F.concat(F.lit("Language: "), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", C.chunk_type(F.col("text")).alias("kind"), header.alias("header"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS n FROM l)
SELECT doc_id, count(*) AS kept, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM r WHERE n = 1 OR length(line) >= 100 GROUP BY 1""")
def deduplicated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their repeated short lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    first = F.row_number().over(Window.partitionBy("doc_id", "line").orderBy("i"))
    kept = lines.withColumn("n", first).where("n = 1 OR length(line) >= 100")
    ordered = F.sort_array(F.collect_list(F.struct("i", "line")))  # the lines of one document
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.md5(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("digest"))


@query("""WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents)
SELECT CASE WHEN o.doc_id IS NULL THEN 'new' WHEN o.h <> n.h THEN 'changed' ELSE 'skipped' END AS action, count(*) AS n FROM n LEFT JOIN o USING (doc_id) GROUP BY 1""")
def sync_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a synchronisation would do: new, changed and unchanged documents by content hash."""
    docs = table(spark, sf_dir, "documents")
    stored = docs.where("doc_id % 3 <> 0").select("doc_id", F.md5("text").alias("old"))
    now = docs.select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    action = F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("h"), "changed").otherwise("skipped")
    return now.join(stored, "doc_id", "left").groupBy(action.alias("action")).agg(F.count("*").alias("n"))
