"""Answers held against their context, relation triples, filters by metadata, promotions, and cleaned texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.operators.cleaning import clean_text, expand_query, map_column
from lakeloom.operators.evaluate import response_quality
from lakeloom.plans.registry import query, table

#: Turns with their words and the words of all earlier turns of the conversation.
CONTEXT_SQL = """t AS (SELECT conv_id, turn, role, text, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations),
c AS (SELECT *, coalesce(list_distinct(flatten(list(w) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), []) AS ctx, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM t)"""


def in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their words (``w``), those of all earlier turns (``ctx``), and their place in the conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", words.alias("w"))
    earlier = F.array_distinct(F.flatten(F.collect_list("w").over(order.rowsBetween(Window.unboundedPreceding, -1))))  # a conversation's turns are few
    return rows.withColumns({"ctx": earlier, "place": F.row_number().over(order)})


@query(f"WITH {CONTEXT_SQL} SELECT conv_id, turn, CAST(len(list_intersect(w, ctx)) AS INTEGER) AS shared, round(len(list_intersect(w, ctx)) / greatest(len(w), 1), 4) AS overlap, len(list_intersect(w, ctx)) < 0.1 * len(w) AS contradicts FROM c WHERE role = 'assistant' AND place > 1")
def context_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of an answer's words its context has; under a tenth of them counts against it."""
    shared, n = F.size(F.array_intersect("w", "ctx")), F.size("w")
    return in_context(spark, sf_dir).where("role = 'assistant' AND place > 1").select("conv_id", "turn", shared.alias("shared"), F.round(shared / F.greatest(n, F.lit(1)), 4).alias("overlap"), (shared < 0.1 * n).alias("contradicts"))


@query(f"""WITH {CONTEXT_SQL}, s AS (SELECT conv_id, turn, ctx, unnest(list_filter(string_split(text, '.'), lambda x: length(trim(x)) > 20)) AS s FROM c WHERE role = 'assistant' AND place > 1),
p AS (SELECT conv_id, turn, ctx, list_distinct(regexp_extract_all(lower(s), '[a-z]+')) AS w FROM s) SELECT conv_id, turn, count(*) AS claims, round(count(*) FILTER (WHERE len(list_intersect(w, ctx)) < 0.4 * len(w)) / count(*), 4) AS unsupported FROM p GROUP BY 1, 2""")
def unsupported_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an answer's sentences that have less than two fifths of their words from the earlier turns."""
    answers = in_context(spark, sf_dir).where("role = 'assistant' AND place > 1")
    claims = answers.select("conv_id", "turn", "ctx", F.explode(F.filter(F.split("text", r"\."), lambda x: F.length(F.trim(x)) > 20)).alias("s"))
    w = claims.select("conv_id", "turn", "ctx", F.array_distinct(F.regexp_extract_all(F.lower("s"), F.lit("[a-z]+"), 0)).alias("w"))
    return w.groupBy("conv_id", "turn").agg(F.count("*").alias("claims"), F.round(F.count_if(F.size(F.array_intersect("w", "ctx")) < 0.4 * F.size("w")) / F.count("*"), 4).alias("unsupported"))


@query(f"""WITH {CONTEXT_SQL}, x AS (SELECT *, len(list_intersect(w, ctx)) AS shared FROM c WHERE role = 'assistant')
SELECT conv_id, turn, CAST(greatest(0.0, round(1.0 - CASE WHEN place > 1 THEN 0.0 ELSE 0.4 END - CASE WHEN shared < 0.1 * len(w) THEN 0.5 ELSE 0.0 END - CASE WHEN length(text) < 50 THEN 0.2 ELSE 0.0 END - CASE WHEN shared = 0 THEN 0.3 ELSE 0.0 END, 2)) AS DOUBLE) + 0.0 AS score FROM x""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every answer: whether it has a context, departs from it, is short, or shares nothing with it."""
    shared = F.size(F.array_intersect("w", "ctx"))
    score = response_quality(F.col("place") > 1, shared < 0.1 * F.size("w"), F.length("text"), shared)
    return in_context(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn", score.alias("score"))


_S = r"[ \t\n\f\r]"
#: What a relation's mention looks like, its subject and object, and how sure it is.
RELATIONS = {
    "is_a": (rf"(?i)([A-Z][a-zA-Z \t\n\f\r]{{2,40}}){_S}+is{_S}+a(?:{_S}+type{_S}+of)?{_S}+([a-z][a-z \t\n\f\r]{{2,30}})", 0.8),
    "made_by": (rf"(?i)([A-Z][a-zA-Z \t\n\f\r]{{2,40}}){_S}+(?:by|from){_S}+([A-Z][a-zA-Z]{{2,30}})", 0.75),
    "available_in": (rf"(?i)([A-Z][a-zA-Z \t\n\f\r]{{2,40}}){_S}+(?:comes?|available){_S}+in{_S}+([a-z][a-z, \t\n\f\r/]{{2,50}})", 0.75),
    "similar_to": (rf"(?i)([A-Z][a-zA-Z \t\n\f\r]{{2,40}}){_S}+(?:is{_S}+)?similar{_S}+to{_S}+([A-Z][a-zA-Z \t\n\f\r]{{2,40}})", 0.8),
    "variant_of": (rf"(?i)([A-Z][a-zA-Z \t\n\f\r]{{2,40}}){_S}+is{_S}+a{_S}+variant{_S}+of{_S}+([A-Z][a-zA-Z \t\n\f\r]{{2,40}})", 0.9),
    "goes_with": (rf"(?i)([A-Z][a-zA-Z \t\n\f\r]{{2,40}}){_S}+(?:pairs?{_S}+well{_S}+with|goes?{_S}+with){_S}+([A-Z][a-zA-Z \t\n\f\r]{{2,40}})", 0.75),
    "policy_covers": (rf"(?i)(return|shipping|warranty|refund){_S}+policy{_S}+covers?{_S}+([a-z][a-z \t\n\f\r,]{{2,60}})", 0.85),
}
#: Words that every mention of a relation has, each a cheap test of a whole text.
WORDS = {
    "is_a": rf"(?i){_S}is{_S}+a{_S}", "made_by": rf"(?i)[a-z \t\n\f\r]{_S}(?:by|from){_S}+[a-z]", "available_in": rf"(?i){_S}(?:comes?|available){_S}+in{_S}", "similar_to": rf"(?i)similar{_S}+to{_S}",
    "variant_of": rf"(?i)variant{_S}+of{_S}", "goes_with": rf"(?i){_S}(?:pairs?{_S}+well|goes?){_S}+with{_S}", "policy_covers": rf"(?i)policy{_S}+covers?{_S}",
}
_TRIPLES_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS relation, unnest(regexp_extract_all(text, '{p}', 1)) AS subject, unnest(regexp_extract_all(text, '{p}', 2)) AS object, CAST({sure} AS DOUBLE) AS confidence FROM documents" for name, (p, sure) in RELATIONS.items()
)


@query(f"WITH r AS ({_TRIPLES_SQL}) SELECT relation, lower(trim(subject, E' \\t\\n\\f\\r')) AS subject, lower(trim(object, E' \\t\\n\\f\\r')) AS object, confidence, count(*) AS n FROM r GROUP BY ALL")
def relation_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, relation and object of seven kinds of sentences, with how often each is said."""
    kinds = [_triples(name, p, sure) for name, (p, sure) in RELATIONS.items()]
    return table(spark, sf_dir, "documents").select(F.explode(F.concat(*kinds)).alias("r")).groupBy("r.relation", "r.subject", "r.object", "r.confidence").agg(F.count("*").alias("n"))


def _triples(name: str, pattern: str, sure: float) -> Column:
    """The triples of one relation; texts without its words are passed over at once, and each mention is split by itself."""
    mentions = F.when(F.col("text").rlike(WORDS[name]), F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))
    part = lambda m, i: _bare(F.regexp_extract(m, pattern, i))
    return F.transform(mentions, lambda m: F.struct(F.lit(name).alias("relation"), part(m, 1).alias("subject"), part(m, 2).alias("object"), F.lit(sure).alias("confidence")))


def _bare(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", ""))


def metadata_filters(lang: str | None = None, source: str | None = None, longest: int | None = None) -> list[Column]:
    """Conditions for the filters that are given: language, part of the source's name, most characters."""
    given = [(lang, lambda x: F.col("lang") == x), (source, lambda x: F.contains(F.col("source"), F.lit(x))), (longest, lambda x: F.col("n_chars") <= x)]
    return [condition(x) for x, condition in given if x]


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND contains(source, 'src1') AND n_chars <= 2000")
def filtered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that meet the filters asked for."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    for condition in metadata_filters(lang="en", source="src1", longest=2000):
        rows = rows.where(condition)
    return rows


@query("SELECT l_partkey, count(*) AS offers, count(*) FILTER (WHERE l_extendedprice > l_extendedprice * (1 - l_discount)) AS promotions, round(max(l_discount), 4) AS deepest FROM lineitem GROUP BY 1")
def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers whose price is below the price they are compared with, by product."""
    c = F.col
    flag = c("l_extendedprice") > c("l_extendedprice") * (1 - c("l_discount"))
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("offers"), F.count_if(flag).alias("promotions"), F.round(F.max("l_discount"), 4).alias("deepest"))


@query()
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and size of every text without noise, navigation and repeated short lines."""
    rows = map_column(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", clean_text, "clean")
    return rows.select("doc_id", F.length("clean").alias("n_chars"), F.md5("clean").alias("digest"))


@query()
def expanded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as keyword queries with synonyms."""
    return map_column(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", expand_query, "expanded").select("conv_id", "turn", "expanded")
