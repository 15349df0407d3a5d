"""Look-ups by keyword and label, terms of questions, contexts to compare, validated answers, and cache states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions.scripts import ENDPOINTS, script_endpoints
from lakeloom.operators.evaluate import mean_scores
from lakeloom.operators.graph import reach
from lakeloom.operators.lookup import cache_state, contained, entities, reasoning_kind, rerank, search_terms, structured_context, substrings
from lakeloom.operators.search import bm25
from lakeloom.plans.knowledge import record_texts
from lakeloom.plans.products import COMPLETENESS_SQL, PRIORITY_SQL, fused_fields, scored
from lakeloom.plans.registry import query, table
from lakeloom.plans.retrieval import BM25_SQL, PAIRS_SQL, benchmark_queries, product_top_k

#: Words of a question that are not looked for in addresses.
STOP = ("show", "me", "the", "what", "is", "are", "this", "does", "how", "give", "all", "for", "do", "you", "a", "an", "in")


@query(f"""WITH q AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w FROM benchmark) WHERE w NOT IN {STOP}),
m AS (SELECT DISTINCT item_id, page_id, rtrim(url, '/') AS url, length(html) AS size FROM q JOIN pages ON contains(lower(url), w)), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY size DESC NULLS LAST, page_id) AS rank FROM m)
SELECT item_id, rank, page_id, url FROM r WHERE rank <= 3""")
def resolved_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most complete pages (here: the largest) whose address holds a keyword of the question.

    The words are matched with the addresses' substrings, and of every word only
    its three best pages go on: the best of a question are among them.
    """
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("w")).where(~F.col("w").isin(*STOP)).distinct()
    pages = table(spark, sf_dir, "pages").select("page_id", F.rtrim("url", F.lit("/")).alias("url"), F.length("html").alias("size"), F.explode(substrings(F.col("url"))).alias("w"))
    best = lambda rows, by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last("size"), "page_id"))).where("rank <= 3")
    of_word = best(pages.join(words.select("w").distinct(), "w", "left_semi"), "w").drop("rank")
    return best(words.join(of_word, "w").select("item_id", "page_id", "url", "size").distinct(), "item_id").select("item_id", "rank", "page_id", "url")


@query("""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '[a-z]{3,}')) AS node FROM pages), e AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS entity FROM benchmark)
SELECT node, entity FROM n JOIN e ON contains(node, entity) OR contains(entity, node)""")
def matching_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node labels (words of hosts) and entity labels (words of questions) of which one is part of the other."""
    words = lambda c, name: F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), 0)).alias(name)
    nodes = table(spark, sf_dir, "pages").select(words(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), "node")).distinct()
    names = table(spark, sf_dir, "benchmark").select(words("text", "entity")).distinct()
    inside = contained(names.select(F.col("entity").alias("needle")), nodes.select(F.col("node").alias("label"))).select(F.col("label").alias("node"), F.col("needle").alias("entity"))
    around = contained(nodes.select(F.col("node").alias("needle")), names.select(F.col("entity").alias("label"))).select(F.col("needle").alias("node"), F.col("label").alias("entity"))
    return inside.union(around).distinct()


@query()
def message_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five capitalised phrases of every message."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", entities(F.col("text")).alias("entities"))


@query()
def message_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a structured look-up would search for, for every message."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", search_terms(F.col("text")).alias("terms"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS i, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations),
e AS (SELECT conv_id, role, '[' || role || ']' || chr(10) || string_agg(left(text, 2000 // n), chr(10) || chr(10) ORDER BY i) AS part FROM r WHERE i <= 3 GROUP BY 1, 2) SELECT conv_id, string_agg(part, chr(10) || chr(10) || '===' || chr(10) || chr(10) ORDER BY role) AS context FROM e GROUP BY 1""")
def comparison_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each speaker's first three messages side by side, 2,000 characters a speaker shared by all of its messages."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text")
    sizes = rows.groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text"))).where("i <= 3")
    cut = first.join(sizes, ["conv_id", "role"]).select("conv_id", "role", F.struct("i", F.substring("text", F.lit(1), F.floor(2000 / F.col("n")).cast("int")).alias("t")).alias("x"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n\n")
    parts = cut.groupBy("conv_id", "role").agg(F.concat(F.lit("["), F.col("role"), F.lit("]\n"), texts).alias("part"))
    return parts.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("role", "part"))), lambda x: x["part"]), "\n\n===\n\n").alias("context"))


#: Phrases that contradict, cite, claim too much, or are vague.
CONTRAST = (" however, ", " but ", " although ", " whereas ")
CITATION = ("according to", "based on", "from", "source:", "[")
CONFIDENT = ("always", "never", "definitely", "certainly", "absolutely")
VAGUE = ("may be", "could be", "might be", "perhaps", "apparently")


def _times_sql(phrases: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"(length(t) - length(replace(t, '{p}', ''))) // {len(p)}" for p in phrases) + ")"


def _times(text: Column, phrases: tuple[str, ...]) -> Column:
    """How often the phrases occur, each counted without overlap."""
    one = lambda p: F.floor((F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p))
    return sum((one(p) for p in phrases[1:]), one(phrases[0]))


VALIDATED_SQL = f"""t AS (SELECT conv_id, turn, role, lower(text) AS t, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w, row_number() OVER o - 1 AS sources,
last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT *, list_distinct(regexp_extract_all(lower(coalesce(question, '')), '[a-z]+')) AS qw FROM t WHERE role = 'assistant'),
n AS (SELECT *, {_times_sql(CONTRAST)} AS contrasts, {_times_sql(CITATION)} AS cited, {_times_sql(CONFIDENT)} AS sure, {_times_sql(VAGUE)} AS vague FROM q),
f AS (SELECT conv_id, turn, length(t) AS size, CASE WHEN contrasts > 3 THEN 7e-1 WHEN contrasts > 1 THEN 4e-1 ELSE 1e-1 END AS contradiction,
CASE WHEN len(w) = 0 OR len(qw) = 0 THEN 0e0 ELSE len(list_intersect(w, qw)) / sqrt(CAST(len(w) * len(qw) AS DOUBLE)) END AS relevance,
CASE WHEN sources = 0 THEN 3e-1 ELSE least(1e0, cited / greatest(1e0, sources * 5e-1)) END AS citation,
CASE WHEN sure + vague = 0 THEN 7e-1 WHEN vague / (sure + vague) BETWEEN 3e-1 AND 7e-1 THEN 9e-1 WHEN vague > 0 AND vague / (sure + vague) < 3e-1 THEN 4e-1 ELSE 5e-1 END AS factual FROM n),
s AS (SELECT *, round(100 * (CASE WHEN contradiction > 5e-1 THEN contradiction * 3e-1 ELSE 0e0 END + CASE WHEN relevance < 5e-1 THEN (1 - relevance) * 3e-1 ELSE 0e0 END + CASE WHEN citation < 5e-1 THEN (1 - citation) * 2e-1 ELSE 0e0 END + CASE WHEN factual < 5e-1 THEN (1 - factual) * 2e-1 ELSE 0e0 END), 4) AS score FROM f),
v AS (SELECT *, CASE WHEN score > 75 THEN 'high' WHEN score > 50 THEN 'medium' WHEN score > 25 THEN 'low' ELSE 'minimal' END AS level FROM s)"""


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer with the four checks of the older validator, its score (0 to 100) and level.

    The question is the last earlier message of the user, the sources are the
    earlier turns, and relevance is the cosine of the two sets of words.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0))
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", (F.row_number().over(order) - 1).alias("sources"), asked.alias("question")).where("role = 'assistant'")
    t = F.lower("text")
    counted = rows.select(
        "conv_id", "turn", "sources", F.length(t).alias("size"), words("text").alias("w"), words(F.coalesce("question", F.lit(""))).alias("qw"),
        _times(t, CONTRAST).alias("contrasts"), _times(t, CITATION).alias("cited"), _times(t, CONFIDENT).alias("sure"), _times(t, VAGUE).alias("vague"),
    )
    c, n, q = F.col, F.size("w"), F.size("qw")
    share = c("vague") / (c("sure") + c("vague"))
    checks = counted.select(
        "conv_id", "turn", "size", F.when(c("contrasts") > 3, 0.7).when(c("contrasts") > 1, 0.4).otherwise(0.1).alias("contradiction"),
        F.when((n == 0) | (q == 0), 0.0).otherwise(F.size(F.array_intersect("w", "qw")) / F.sqrt((n * q).cast("double"))).alias("relevance"),
        F.when(c("sources") == 0, 0.3).otherwise(F.least(F.lit(1.0), c("cited") / F.greatest(F.lit(1.0), c("sources") * 0.5))).alias("citation"),
        F.when(c("sure") + c("vague") == 0, 0.7).when(share.between(0.3, 0.7), 0.9).when((c("vague") > 0) & (share < 0.3), 0.4).otherwise(0.5).alias("factual"),
    )
    short = lambda name, weight: F.when(c(name) < 0.5, (1 - c(name)) * weight).otherwise(0.0)
    score = F.round(100 * (F.when(c("contradiction") > 0.5, c("contradiction") * 0.3).otherwise(0.0) + short("relevance", 0.3) + short("citation", 0.2) + short("factual", 0.2)), 4)
    level = F.when(c("score") > 75, "high").when(c("score") > 50, "medium").when(c("score") > 25, "low").otherwise("minimal")
    return checks.withColumn("score", score).withColumn("level", level)


@query(f"WITH {VALIDATED_SQL} SELECT conv_id, turn, round(contradiction, 4) AS contradiction, round(relevance, 4) AS relevance, round(citation, 4) AS citation, round(factual, 4) AS factual, score, level FROM v")
def validated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradiction, relevance, citation and wording of every answer, with the score and level that follow."""
    parts = [F.round(x, 4).alias(x) for x in ("contradiction", "relevance", "citation", "factual")]
    return validated(spark, sf_dir).select("conv_id", "turn", *parts, "score", "level")


@query(f"WITH {VALIDATED_SQL} SELECT level, count(*) AS answers, round(avg(score), 3) AS mean_score FROM v GROUP BY 1")
def validation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and their mean score by level."""
    return validated(spark, sf_dir).groupBy("level").agg(F.count("*").alias("answers"), F.round(F.avg("score"), 3).alias("mean_score"))


_DIMENSIONS = ("relevance", "accuracy", "completeness", "conciseness", "groundedness")
_MEANS = ", ".join(f"round(avg({d}), 4) AS mean_{d}" for d in _DIMENSIONS)
_OVERALL = f"({' + '.join(_DIMENSIONS)}) / 5"


@query(f"""WITH {VALIDATED_SQL}, d AS (SELECT conv_id, 10 * relevance AS relevance, 10 * factual AS accuracy, 10 * least(1e0, size / 500) AS completeness, 10 * least(1e0, 500 / greatest(size, 1)) AS conciseness, 10 * citation AS groundedness FROM v)
SELECT conv_id, count(*) AS n, {_MEANS}, round(avg({_OVERALL}), 4) AS mean_overall, count(*) FILTER (WHERE round({_OVERALL}, 2) < 5) AS low_quality FROM d GROUP BY 1""")
def answer_quality_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five dimensions of a conversation's answers on a scale of ten, and how many answers fall below five.

    Nothing judges answers here: the dimensions come from the older validator's checks and the answer's length.
    """
    c = F.col
    rows = validated(spark, sf_dir).select(
        "conv_id", (10 * c("relevance")).alias("relevance"), (10 * c("factual")).alias("accuracy"), (10 * F.least(F.lit(1.0), c("size") / 500)).alias("completeness"),
        (10 * F.least(F.lit(1.0), 500 / F.greatest(c("size"), F.lit(1)))).alias("conciseness"), (10 * c("citation")).alias("groundedness"),
    )
    return mean_scores(rows, "conv_id", list(_DIMENSIONS))


@query(f"""WITH {PAIRS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p WHERE similarity >= 0.35), {COMPLETENESS_SQL}
SELECT query_id, count(*) AS found, round(avg(score * similarity), 4) AS weighted FROM k JOIN c ON p_partkey = id WHERE rank <= 20 GROUP BY 1""")
def weighted_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of completeness times similarity over the products found for a query (products and vectors share ids here)."""
    found = product_top_k(spark, sf_dir).select("query_id", F.col("id").alias("p_partkey"), "similarity")
    return found.join(scored(spark, sf_dir), "p_partkey").groupBy("query_id").agg(F.count("*").alias("found"), F.round(F.avg(F.col("score") * F.col("similarity")), 4).alias("weighted"))


@query(f"""WITH f AS (SELECT l_partkey, l_returnflag AS field, l_extendedprice AS value, {PRIORITY_SQL} AS priority FROM lineitem), b AS (SELECT l_partkey, field, max(priority) AS priority, count(DISTINCT value) - 1 AS conflicts FROM f GROUP BY 1, 2)
SELECT l_partkey, round(avg(priority / 100), 3) AS mean_confidence, count(*) FILTER (WHERE priority < 50) AS low_fields, CAST(sum(conflicts) AS BIGINT) AS conflicts FROM b GROUP BY 1""")
def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure a product's fused fields are (their source's priority, in hundredths), and their conflicts."""
    fused = fused_fields(spark, sf_dir)
    return fused.groupBy("l_partkey").agg(F.round(F.avg(F.col("priority") / 100), 3).alias("mean_confidence"), F.count_if(F.col("priority") < 50).alias("low_fields"), F.sum("conflicts").cast("long").alias("conflicts"))


@query("""WITH g AS (SELECT *, ts - lag(ts) OVER w > INTERVAL 1 HOUR AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
k AS (SELECT *, max(run) OVER (PARTITION BY user_id) AS last, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM s) SELECT user_id, count(*) AS entries, min(ts) AS oldest, max(ts) AS newest FROM k WHERE run = last AND back <= 100 GROUP BY 1""")
def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every user's answer cache holds after the user's last event: at most 100 entries, none before an hour's pause."""
    return cache_state(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


_CALLS = " || ".join("regexp_extract_all(html, '" + p.replace("'", "''") + "', 1)" for p in ENDPOINTS)


@query(f"WITH e AS (SELECT page_id, {_CALLS} AS found FROM pages) SELECT page_id, least(len(list_distinct(found)), 20) AS endpoints FROM e")
def called_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many addresses each page's scripts call (those of the bundled pages call none)."""
    return table(spark, sf_dir, "pages").select("page_id", F.size(script_endpoints(F.col("html"), F.col("url"))).cast("long").alias("endpoints"))


_BELONGS_SQL = """e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b, 'belongs_to' AS kind FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey, 'belongs_to' FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'belongs_to' FROM nation
UNION SELECT 'p' || l_partkey, 's' || l_suppkey, 'offered_by' FROM lineitem)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, kind): customers and suppliers belong to nations, nations to regions, and products are offered by suppliers."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    link = lambda t, x, a, y, b, kind: table(spark, sf_dir, t).select(name(x, a).alias("a"), name(y, b).alias("b"), F.lit(kind).alias("kind"))
    belongs = link("customer", "c", "c_custkey", "n", "c_nationkey", "belongs_to").unionByName(link("supplier", "s", "s_suppkey", "n", "s_nationkey", "belongs_to")).unionByName(link("nation", "n", "n_nationkey", "r", "n_regionkey", "belongs_to"))
    return belongs.unionByName(link("lineitem", "p", "l_partkey", "s", "l_suppkey", "offered_by")).distinct()


def _walk_sql(kind: str, depth: int) -> str:
    return f"""WITH RECURSIVE {_BELONGS_SQL}, h AS (SELECT DISTINCT a AS seed, a AS node, 0 AS hops FROM e WHERE CAST(substr(a, 2) AS BIGINT) % 100 = 0 UNION SELECT seed, b, hops + 1 FROM h JOIN e ON a = node WHERE {kind} AND hops < {depth})
SELECT seed, node, min(hops) AS hops FROM h WHERE hops > 0 GROUP BY 1, 2"""


def _walk(links: DataFrame, kind: str | None, depth: int) -> DataFrame:
    seeds = links.where(F.substring("a", 2, 20).cast("long") % 100 == 0).select(F.col("a").alias("seed"), F.col("a").alias("node"))
    return reach(links.where(F.col("kind") == kind) if kind else links, seeds, depth).where("hops > 0")


@query(_walk_sql("kind = 'belongs_to'", 2))
def typed_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where links of one kind lead in two directed steps from each node whose number is divisible by 100."""
    return _walk(_links(spark, sf_dir), "belongs_to", 2)


@query(_walk_sql("true", 3))
def directed_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where links of any kind lead in three directed steps from each node whose number is divisible by 100."""
    return _walk(_links(spark, sf_dir), None, 3)


@query(f"""WITH {BM25_SQL}, h AS (SELECT query_id, id, list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(left(x.text, 400)), '[a-z0-9]+')) AS b FROM k JOIN benchmark q ON item_id = query_id JOIN documents x ON doc_id = id WHERE rank <= 20),
z AS (SELECT query_id, id, round(len(list_intersect(a, b)) / greatest(len(list_distinct(a || b)), 1), 6) AS score FROM h) SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM z) WHERE rank <= 5""")
def reranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five of twenty keyword hits whose beginning (400 characters) shares most words with the question."""
    questions, docs = benchmark_queries(spark, sf_dir), table(spark, sf_dir, "documents")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0))
    hits = bm25(questions, docs, 20).select("query_id", "id").join(questions.select("query_id", words("text").alias("a")), "query_id")
    hits = hits.join(docs.select(F.col("doc_id").alias("id"), words(F.substring("text", 1, 400)).alias("b")), "id")
    score = F.round(F.size(F.array_intersect("a", "b")) / F.greatest(F.size(F.array_union("a", "b")), F.lit(1)), 6)
    return rerank(hits, score, 5).select("query_id", "rank", "id", "score")


@query("SELECT p_partkey, 'Product: ' || p_name || chr(10) || 'Price: ' || printf('%.2f', p_retailprice) || ' BDT' AS context FROM part SEMI JOIN lineitem ON l_partkey = p_partkey")
def structured_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short context made of the fields of every product's record text."""
    return record_texts(spark, sf_dir).select("p_partkey", structured_context(F.col("content")).alias("context"))


@query()
def reasoning_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the graph would answer every message."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reasoning_kind(F.col("text"), entities(F.col("text"))).alias("kind"))
