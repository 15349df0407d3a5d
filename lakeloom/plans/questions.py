"""Question planning, memory facts and governance decisions over messages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import classify as C
from lakeloom.functions import planning as P
from lakeloom.functions import vocabulary as V
from lakeloom.plans.registry import query, table
from lakeloom.plans.texts import INTENT_SQL, REQUEST_SQL, RISK_SQL, any_sql, count_sql, override_sql, s

_L = "lower(text)"
_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
_NOISE = ", ".join(map(s, P.NOISE))


@query(f"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(lower(trim(text)), '[?!.]+$', ''), '\\s+'), lambda w: w <> '') AS w FROM conversations), k AS (SELECT *, list_filter(w, lambda x: NOT list_contains([{_NOISE}], x)) AS k FROM w)
SELECT conv_id, turn, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE w END, ' ') AS keywords FROM k""")
def keyword_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as keyword queries."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.keyword_query(F.col("text")).alias("keywords"))


@query(f"""WITH q AS (SELECT conv_id, turn, text, {INTENT_SQL} AS intent, regexp_matches(text, {s(V.SKU)}) AS sku, {any_sql(_L, V.CATEGORIES)} AS ent, len({_WORDS}) AS n FROM conversations),
r AS (SELECT *, CASE WHEN sku THEN 'BM25_ONLY' WHEN intent = 'comparison' THEN 'GRAPH' WHEN intent IN ('price_query', 'availability_query') THEN 'STRUCTURED' WHEN intent IN ('policy_lookup', 'faq') THEN 'HYBRID' WHEN intent IN ('product_search', 'general') AND ent THEN 'HYBRID' WHEN n <= 3 THEN 'VECTOR_ONLY' ELSE 'HYBRID' END AS route,
CASE WHEN sku THEN 5 WHEN intent = 'comparison' THEN 10 WHEN intent IN ('price_query', 'availability_query') THEN 8 WHEN intent IN ('policy_lookup', 'faq') THEN 6 WHEN intent IN ('product_search', 'general') AND ent THEN 8 WHEN n <= 3 THEN 5 ELSE 6 END AS top_k FROM q)
SELECT conv_id, turn, intent, route, top_k, CASE WHEN regexp_matches(lower(text), {s(C.word(P.SIMPLE_FIELDS))}) THEN 2 WHEN n <= 3 THEN 2 WHEN n <= 8 THEN 3 ELSE 4 END AS chunks FROM r""")
def retrieval_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent, route and context size of every message."""
    text = F.col("text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", C.product_intent(text).alias("intent"), F.size(P.words(text)).alias("n"))
    plan = P.route(F.col("intent"), text.rlike(V.SKU), C.contains_any(F.lower(text), V.CATEGORIES), F.col("n"))
    return rows.select("conv_id", "turn", "intent", plan.alias("p"), P.context_limits(text, F.col("n")).alias("c")).select("conv_id", "turn", "intent", "p.route", "p.top_k", "c.chunks")


@query(f"""WITH q AS (SELECT conv_id, turn, {REQUEST_SQL} AS kind, CASE WHEN {override_sql(_L)} > 0 THEN 'critical' ELSE 'low' END AS risk FROM conversations) SELECT conv_id, turn, kind, CASE WHEN risk = 'critical' OR kind = 'reasoning' THEN 'large' ELSE 'small' END AS model FROM q""")
def model_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that answers: the large one for risky messages and reasoning."""
    risk = F.when(C.jailbreak_hits(F.col("text")) > 0, "critical").otherwise("low")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.request_class(F.col("text")).alias("kind"), risk.alias("r")).select("conv_id", "turn", "kind", P.model(F.col("kind"), F.col("r")).alias("model"))


@query(f"""WITH f AS (SELECT conv_id, turn, regexp_extract(text, '(?i)(?:my name is|i am|i''m|call me)\\s+([a-z]+)', 1) AS n, regexp_extract(upper(text), '(ORD-?\\d{{4,}}|ORDER\\s+#?\\d{{4,}})', 1) AS o, {any_sql(_L, ("cash on delivery", "cod"))} AS c, regexp_extract({_L}, {s(C.word(P.LOCATIONS))}, 2) AS p FROM conversations),
a AS (SELECT conv_id, turn, list_filter([CASE WHEN n <> '' THEN 'name=' || lower(n) END, CASE WHEN o <> '' THEN 'order=' || o END, CASE WHEN c THEN 'payment=cash on delivery' END, CASE WHEN p <> '' THEN 'place=' || p END], lambda x: x IS NOT NULL) AS facts FROM f)
SELECT conv_id, count(*) AS turns, CAST(sum(len(facts)) AS BIGINT) AS facts FROM a GROUP BY 1""")
def memory_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many facts each conversation's messages tell."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.size(P.facts(F.col("text"))).alias("n")).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("n").alias("facts"))


_PII_ANY = f"{count_sql('text', ['(?i)' + p for p in V.PII.values()])} > 0"
_HIGH = any_sql(_L, V.COMPLIANCE["no_medical_diagnosis"][1])
_JAIL = f"{override_sql(_L)} > 0"
DECISION_SQL = f"""d AS (SELECT doc_id, lang, {_JAIL} AS j, {any_sql(_L, V.SENSITIVE_TOPICS)} AS t, {any_sql(_L, V.UNSAFE_WORDS)} AS u, {_PII_ANY} AS p, {_HIGH} AS h, {", ".join(f"{any_sql(_L, x)} AS {r}" for r, (_, x) in V.COMPLIANCE.items())} FROM documents),
e AS (SELECT doc_id, lang, CASE WHEN j OR t THEN 'block' WHEN u OR h THEN 'warn' ELSE 'allow' END AS action, CASE WHEN j OR t THEN 'critical' WHEN u THEN 'high' WHEN p OR h THEN 'medium' ELSE 'low' END AS level,
CASE WHEN j THEN ['jailbreak_detected'] WHEN t THEN ['unsafe_content'] ELSE list_filter([CASE WHEN u THEN 'unsafe_content' END, CASE WHEN p THEN 'pii_detected' END, {", ".join(f"CASE WHEN {r} THEN '{r}' END" for r in V.COMPLIANCE)}], lambda x: x IS NOT NULL) END AS flags FROM d)"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", P.decision(F.col("text")).alias("d")).select("doc_id", "lang", "d.action", "d.level", "d.flags")


@query(f"WITH {DECISION_SQL} SELECT * FROM e")
def governance_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block, warn or allow, with the level and the reasons."""
    return decided(spark, sf_dir)


@query(f"WITH {DECISION_SQL} SELECT lang, count(*) AS n, count(*) FILTER (WHERE action = 'block') AS blocked, round(count(*) FILTER (WHERE action = 'block') / count(*), 4) AS block_rate, count(*) FILTER (WHERE len(flags) > 0) AS flagged FROM e GROUP BY 1")
def governance_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by language."""
    blocked = F.count_if(F.col("action") == "block")
    return decided(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), blocked.alias("blocked"), F.round(blocked / F.count("*"), 4).alias("block_rate"), F.count_if(F.size("flags") > 0).alias("flagged"))


@query(f"""WITH {RISK_SQL}, {DECISION_SQL}, x AS (SELECT b.doc_id, list_filter([CASE WHEN score >= 70 THEN 'high_risk_score' END, CASE WHEN fraud >= 75 THEN 'critical_fraud' END, CASE WHEN list_contains(flags, 'jailbreak_detected') THEN 'jailbreak_attempt' END, CASE WHEN len(flags) >= 3 THEN 'repeated_violations' END], lambda x: x IS NOT NULL) AS rules FROM b JOIN e USING (doc_id))
SELECT doc_id, rules, len(rules) > 0 AS escalate FROM x""")
def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are escalated, and why."""
    from lakeloom.plans.texts import risk

    joined = risk(spark, sf_dir, P.decision(F.col("text"))["flags"]).select("doc_id", "score", "fraud", F.col("more_0").alias("flags"))
    rules = P.escalation(F.col("score"), F.col("fraud"), F.array_contains("flags", "jailbreak_detected"), F.size("flags"))
    return joined.select("doc_id", rules.alias("rules")).withColumn("escalate", F.size("rules") > 0)


@query(f"""SELECT doc_id, CAST(least(100, {count_sql(_L, P.LEAK_WORDS)} * 20) AS INTEGER) AS leak, CAST(least(100, {count_sql('text', ['(?i)' + p for p in V.PII.values()])} * 25) AS INTEGER) AS pii,
CASE WHEN {count_sql(_L, P.LEAK_WORDS)} > 0 OR {count_sql('text', ['(?i)' + p for p in V.PII.values()])} > 2 THEN 'high' WHEN {_PII_ANY} THEN 'medium' ELSE 'low' END AS level FROM documents""")
def leakage_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leakage and personal-data scores, and the higher of their levels."""
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", P.leak_score(text).alias("leak"), C.matched_patterns(text, ["(?i)" + p for p in V.PII.values()]).alias("n"))
    level = F.when((F.col("leak") > 0) | (F.col("n") > 2), "high").when(F.col("n") > 0, "medium").otherwise("low")
    return rows.select("doc_id", "leak", F.least(F.lit(100), F.col("n") * 25).alias("pii"), level.alias("level"))


RULES = [
    {"name": "has_source", "field": "source", "required": True}, {"name": "not_too_long", "field": "text", "max_length": 5000},
    {"name": "no_license", "field": "text", "forbidden": ["licensed under", "all rights reserved"]}, {"name": "starts_upper", "field": "text", "pattern": "^[A-Z]"},
]


@query("""SELECT doc_id, list_filter([CASE WHEN source IS NULL OR source = '' THEN 'has_source' END, CASE WHEN length(text) > 5000 THEN 'not_too_long' END, CASE WHEN contains(lower(text), 'licensed under') OR contains(lower(text), 'all rights reserved') THEN 'no_license' END,
CASE WHEN NOT regexp_matches(text, '^[A-Z]') THEN 'starts_upper' END], lambda x: x IS NOT NULL) AS violations FROM documents""")
def policy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarative rules compiled to one expression."""
    return table(spark, sf_dir, "documents").select("doc_id", P.policy_violations(RULES, {"source": F.col("source"), "text": F.col("text")}).alias("violations"))
