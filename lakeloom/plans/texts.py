"""Text classification over ``documents`` and ``conversations``, with the SQL built of the same word lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import classify as C
from lakeloom.functions import vocabulary as V
from lakeloom.plans.registry import query, table


def s(x: str) -> str:
    """An SQL string."""
    return "'" + x.replace("'", "''") + "'"


def any_sql(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, {s(p)})" for p in phrases) + ")"


def count_sql(column: str, patterns) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({column}, {s(p)}) AS INTEGER)" for p in patterns) + ")"


def override_sql(column: str) -> str:
    """How many override patterns match.  The two with a look-ahead count their beginnings and those that go on with the excluded word."""
    n = lambda p: f"len(regexp_extract_all({column}, {s(p)}))"
    more = " + ".join(f"CAST({n(p)} > {n(p + 'assistant')} AS INTEGER)" for p in ("you are now ", "act as (?:if you are|a|an) "))
    return f"({count_sql(column, [*V.JAILBREAK, *V.INJECTION])} + {more})"


def times_sql(column: str, phrases) -> str:
    return "(" + " + ".join(f"((length({column}) - length(replace({column}, {s(p)}, ''))) // {len(p)})" for p in phrases) + ")"


PII_SQL = ", ".join(f"CAST(len(regexp_extract_all(text, {s('(?i)' + p)})) AS INTEGER) AS {kind}" for kind, p in V.PII.items())
REDACT_SQL = "text"
for _kind, _p in V.PII.items():
    REDACT_SQL = f"regexp_replace({REDACT_SQL}, {s('(?i)' + _p)}, '[REDACTED_{_kind.upper()}]', 'g')"


@query(f"SELECT doc_id, {PII_SQL} FROM documents")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each kind of personal data."""
    return table(spark, sf_dir, "documents").select("doc_id", *[c.cast("int").alias(k) for k, c in C.pii_counts(F.col("text")).items()])


@query(f"SELECT doc_id, md5({REDACT_SQL}) AS digest FROM documents")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the text with personal data replaced."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.redact(F.col("text"))).alias("digest"))


@query(f"""WITH h AS (SELECT conv_id, turn, {override_sql("lower(text)")} AS hits FROM conversations)
SELECT conv_id, turn, hits, CAST(round(least(1.0, hits * 0.3), 2) AS DOUBLE) AS confidence, CASE WHEN hits > 0 THEN 'critical' ELSE 'low' END AS level FROM h""")
def jailbreaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override attempts in messages."""
    hits = C.jailbreak_hits(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", hits.alias("hits"))
    return rows.select("conv_id", "turn", "hits", F.round(F.least(F.lit(1.0), F.col("hits") * V.JAILBREAK_CONFIDENCE), 2).alias("confidence"), F.when(F.col("hits") > 0, "critical").otherwise("low").alias("level"))


@query(f"""SELECT doc_id, CAST(len(list_filter([{", ".join(map(s, V.UNSAFE_WORDS))}], lambda w: contains(lower(text), w))) AS INTEGER) AS n_words,
CAST(len(list_filter([{", ".join(map(s, V.SENSITIVE_TOPICS))}], lambda w: contains(lower(text), w))) AS INTEGER) AS n_topics,
CASE WHEN {any_sql("lower(text)", V.SENSITIVE_TOPICS)} THEN 'critical' WHEN {any_sql("lower(text)", V.UNSAFE_WORDS)} THEN 'high' ELSE 'low' END AS severity FROM documents""")
def moderation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsafe words and topics."""
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in C.moderation(F.col("text")).items()])


@query("SELECT doc_id, " + ", ".join(f"{any_sql('lower(text)', p)} AS {rule}" for rule, (_, p) in V.COMPLIANCE.items()) + f""",
CASE WHEN {any_sql("lower(text)", V.COMPLIANCE["no_medical_diagnosis"][1])} THEN 'high' WHEN {any_sql("lower(text)", [p for _, x in V.COMPLIANCE.values() for p in x])} THEN 'medium' ELSE 'low' END AS severity FROM documents""")
def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compliance rules and the highest severity."""
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in C.compliance(F.col("text")).items()])


RISK_SQL = f"""r AS (SELECT doc_id, lang, least(100.0, {count_sql("lower(text)", V.FRAUD)} * 25.0) AS fraud, least(100.0, 25.0 * {count_sql("text", ["(?i)" + p for p in V.PII.values()])}) AS pii,
least(100.0, 50.0 * ({times_sql("lower(text)", ("api_key", "password", "secret"))})) AS leakage FROM documents), c AS (SELECT *, least(100.0, (fraud * 0.3 + pii * 0.2 + leakage * 0.15) / 0.65) AS score FROM r),
b AS (SELECT doc_id, lang, CAST(fraud AS DOUBLE) AS fraud, CAST(pii AS DOUBLE) AS pii, CAST(leakage AS DOUBLE) AS leakage, CAST(round(score, 4) AS DOUBLE) AS score, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level, score >= 70 AS escalate FROM c)"""


def risk(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """The scores of every document, and more columns made of its row."""
    names = [f"more_{i}" for i in range(len(more))]
    text = F.col("text")
    found = C.matched_patterns(text, ["(?i)" + p for p in V.PII.values()])
    leaks = sum((C.occurrences(F.lower(text), w) for w in ("api_key", "password", "secret")), F.lit(0))
    parts = table(spark, sf_dir, "documents").select("doc_id", "lang", C.fraud_score(text).alias("fraud"), F.least(F.lit(100.0), found * 25.0).alias("pii"), F.least(F.lit(100.0), leaks * 50.0).alias("leakage"), *[c.alias(n) for c, n in zip(more, names, strict=True)])
    score = C.combined_risk({k: F.col(k) for k in ("fraud", "pii", "leakage")})
    return parts.withColumn("s", score).select("doc_id", "lang", "fraud", "pii", "leakage", F.round("s", 4).alias("score"), C.risk_level(F.col("s")).alias("level"), (F.col("s") >= V.ESCALATION_SCORE).alias("escalate"), *names)


@query(f"WITH {RISK_SQL} SELECT * FROM b")
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fraud, personal data and leakage, weighted into one score with its level."""
    return risk(spark, sf_dir)


@query(f"WITH {RISK_SQL} SELECT lang, level, count(*) AS n, round(avg(score), 4) AS average, count(*) FILTER (WHERE escalate) AS escalated FROM b GROUP BY 1, 2")
def risk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and mean scores by level."""
    return risk(spark, sf_dir).groupBy("lang", "level").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("average"), F.count_if("escalate").alias("escalated"))


_L = "lower(text)"
CONTRADICTION_SQL = f"least(1.0, CASE WHEN {times_sql(_L, V.CONTRAST_WORDS)} > 3 THEN 0.5 WHEN {times_sql(_L, V.CONTRAST_WORDS)} > 1 THEN 0.25 ELSE 0.0 END + " + " + ".join(f"CASE WHEN contains({_L}, {s(a)}) AND contains({_L}, {s(b)}) THEN 0.15 ELSE 0.0 END" for a, b in V.NEGATIONS) + ")"
GROUNDING_SQL = f"""g AS (SELECT doc_id, CAST({CONTRADICTION_SQL} AS DOUBLE) AS contradiction, {times_sql(_L, V.OVERCONFIDENT)} AS o, {times_sql(_L, V.HEDGES)} AS h FROM documents),
c AS (SELECT *, CASE WHEN o + h = 0 THEN 0.7 WHEN h / (o + h) BETWEEN 0.3 AND 0.7 THEN 0.9 WHEN h / (o + h) < 0.3 THEN 0.4 ELSE 0.5 END AS confidence FROM g),
v AS (SELECT doc_id, round(contradiction, 2) AS contradiction, CAST(confidence AS DOUBLE) AS confidence, least(100.0, CASE WHEN contradiction > 0.4 THEN contradiction * 30 ELSE 0.0 END + CASE WHEN confidence < 0.5 THEN (1 - confidence) * 30 ELSE 0.0 END) AS score FROM c)"""


def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", C.contradiction(F.col("text")).alias("c"), C.language_confidence(F.col("text")).alias("confidence"))
    return rows.select("doc_id", F.round("c", 2).alias("contradiction"), "confidence", C.hallucination_score(F.col("c"), F.col("confidence")).alias("score"))


@query(f"WITH {GROUNDING_SQL} SELECT doc_id, contradiction, confidence, CAST(round(score, 2) AS DOUBLE) AS score, CASE WHEN score > 75 THEN 'high' WHEN score > 50 THEN 'medium' WHEN score > 25 THEN 'low' ELSE 'minimal' END AS level FROM v")
def hallucination_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradiction and language confidence, and the score they give without a context."""
    return grounding(spark, sf_dir).withColumn("level", C.hallucination_level(F.col("score"))).withColumn("score", F.round("score", 2))


@query(f"WITH {GROUNDING_SQL}, x AS (SELECT v.score > 10 AS flagged, quality = 0 AS bad FROM v JOIN labels USING (doc_id)) SELECT count(*) AS n, count(*) FILTER (WHERE flagged AND NOT bad) AS false_positives, count(*) FILTER (WHERE bad AND NOT flagged) AS false_negatives, round(count(*) FILTER (WHERE flagged = bad) / count(*), 4) AS accuracy FROM x")
def hallucination_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score's verdicts against labels."""
    flagged, bad = F.col("score") > 10, F.col("quality") == 0
    joined = grounding(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.agg(F.count("*").alias("n"), F.count_if(flagged & ~bad).alias("false_positives"), F.count_if(bad & ~flagged).alias("false_negatives"), F.round(F.count_if(flagged == bad) / F.count("*"), 4).alias("accuracy"))


_Q = "lower(text)"
REQUEST_SQL = (
    f"CASE WHEN ({' OR '.join(f'starts_with(trim({_Q}), {s(g)})' for g in V.GREETINGS)}) AND length(text) < 40 THEN 'greeting' WHEN {any_sql(_Q, V.SMALL_TALK)} AND length(text) < 60 THEN 'small_talk' WHEN {any_sql(_Q, V.IDENTITY)} THEN 'identity' "
    + " ".join(f"WHEN {any_sql(_Q, p)}{' OR ends_with(trim(' + _Q + '), ' + s('?') + ')' if n == 'faq' else ''} THEN '{n}'" for n, p in V.REQUEST_CLASSES.items())
    + " ELSE 'general' END"
)


@query(f"SELECT conv_id, turn, {REQUEST_SQL} AS kind, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM conversations")
def request_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each message as a chat request, and its tokens by the four-characters rule."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.request_class(F.col("text")).alias("kind"), C.context_budget(F.col("text")).alias("tokens"))


def _w(x: str) -> str:
    return s(C.word(x))


INTENT_SQL = (
    f"CASE WHEN regexp_matches({_Q}, {_w(V.COMPARISON)}) THEN 'comparison' WHEN {any_sql(_Q, V.POLICY_WORDS)} THEN 'policy_lookup' WHEN {any_sql(_Q, V.SUPPORT_WORDS)} THEN 'support' WHEN regexp_matches({_Q}, {_w(V.PRICE_WORDS)}) THEN 'price_query' "
    f"WHEN regexp_matches({_Q}, {_w(V.STOCK_WORDS)}) THEN 'availability_query' WHEN regexp_matches({_Q}, {_w(V.SHOP_WORDS)}) THEN 'product_search' WHEN regexp_matches({_Q}, {_w(V.QUESTION_WORDS)}) THEN 'faq' ELSE 'general' END"
)


def _limit_sql(p: str) -> str:
    return f"try_cast(nullif(replace(regexp_extract({_Q}, {s(p)}, 1), ',', ''), '') AS BIGINT)"


@query(f"""SELECT conv_id, turn, {INTENT_SQL} AS intent, {_limit_sql(V.PRICE_MAX)} AS price_max, {_limit_sql(V.PRICE_MIN)} AS price_min,
upper(nullif(regexp_extract({_Q}, {_w(V.SIZES)}, 2), '')) AS size, nullif(regexp_extract({_Q}, {_w(V.COLORS)}, 2), '') AS color,
list_filter([{", ".join(map(s, V.ATTRIBUTES))}], lambda w: contains({_Q}, w)) AS attributes FROM conversations""")
def product_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product questions: intent, limits on price, size and colour, and the attributes named."""
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.product_intent(text).alias("intent"), *[c.alias(k) for k, c in C.constraints(text).items()], C.matched(F.lower(text), V.ATTRIBUTES).alias("attributes"))


@query(f"""WITH q AS (SELECT conv_id, turn, trim({_Q}) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(t, {s(V.PRONOUN_ONLY)}) THEN 'pronoun_only' WHEN regexp_matches(t, {s(V.TOO_SHORT)}) THEN 'too_short'
WHEN len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) <= 3 AND ({" OR ".join(f"regexp_matches(t, {_w(m)})" for m in V.MULTI_MEANING)}) THEN 'multi_meaning' END AS ambiguity FROM q""")
def ambiguities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages too vague to be searched for."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.ambiguity(F.col("text")).alias("ambiguity"))


@query(f"""SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: CASE regexp_replace(lower(w), '[^a-z]', '', 'g') {" ".join(f"WHEN {s(a)} THEN {s(b)}" for a, b in V.TYPOS.items())} ELSE w END), ' ') AS corrected FROM conversations""")
def corrected_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known misspellings put right."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.correct_typos(F.col("text")).alias("corrected"))


_PLAIN = r"[^\pL\pN_]+"


def alone_sql(words) -> str:
    """The whole words of a list that ``n`` (lower case, other characters as single spaces, one at each end) or ``low`` holds."""
    return "list_filter([" + ", ".join(f"CASE WHEN contains(n, ' {w} ') THEN '{w}' END" if w.isalnum() else f"CASE WHEN regexp_matches(low, '(^|[^\\pL\\pN_]){w}([^\\pL\\pN_]|$)') THEN '{w}' END" for w in words) + "], lambda x: x IS NOT NULL)"


def alone(words) -> Column:
    hit = lambda w: F.contains(F.col("n"), F.lit(f" {w} ")) if w.isalnum() else F.col("low").rlike(rf"(^|[^\pL\pN_]){w}([^\pL\pN_]|$)")
    return F.filter(F.array(*[F.when(hit(w), w) for w in words]), lambda x: x.isNotNull())


@query(f"""WITH t AS (SELECT doc_id, text, lower(text) AS low, ' ' || regexp_replace(lower(text), '[^\\pL\\pN_]+', ' ', 'g') || ' ' AS n FROM documents)
SELECT doc_id, {alone_sql(V.CATEGORIES)} AS categories, regexp_extract_all(text, {s(V.SKU)}, 1) AS skus, list_filter([{", ".join(map(s, V.BRANDS))}], lambda w: contains(low, w)) AS brands, {alone_sql(V.PLACES)} AS places FROM t""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product categories, stock codes, brands and places named in a text; categories and places as whole words."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", F.lower("text").alias("low"), F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), _PLAIN, " "), F.lit(" ")).alias("n"))
    return texts.select("doc_id", alone(V.CATEGORIES).alias("categories"), F.regexp_extract_all("text", F.lit(V.SKU), 1).alias("skus"), C.matched(F.col("low"), V.BRANDS).alias("brands"), alone(V.PLACES).alias("places"))


@query("""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[\\x{0980}-\\x{09FF}]')) AS bengali, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, len(regexp_extract_all(text, '[À-ÿ]')) AS accented FROM documents)
SELECT doc_id, CAST(latin AS INTEGER) AS latin, CAST(accented AS INTEGER) AS accented, CASE WHEN bengali > latin THEN 'bn' WHEN accented * 20 > latin THEN 'accented' WHEN latin > 0 THEN 'latin' ELSE 'none' END AS script FROM c""")
def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script of a text, by counts of letters."""
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("int")
    rows = table(spark, sf_dir, "documents").select("doc_id", n("[ঀ-৿]").alias("bengali"), n("[A-Za-z]").alias("latin"), n("[À-ÿ]").alias("accented"))
    kind = F.when(F.col("bengali") > F.col("latin"), "bn").when(F.col("accented") * 20 > F.col("latin"), "accented").when(F.col("latin") > 0, "latin").otherwise("none")
    return rows.select("doc_id", "latin", "accented", kind.alias("script"))
