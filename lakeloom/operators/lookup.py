"""Look-ups by part of a name, search terms of a question, and what a bounded cache holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- Fixed values: words of a question that say nothing of what is looked for, and how many entities and terms are kept.
NOISE = ("price", "how", "much", "cost", "available", "availability", "in", "stock", "is", "the", "what", "rate", "how much")
ENTITIES, ENTITY_TERMS, TERMS = 5, 4, 6
_WORD = r"\p{L}\p{N}_"
PHRASE = rf"(?<![{_WORD}])[A-Z][a-zA-Z]+(?:[ \t\n\x0B\f\r]+[A-Z][a-zA-Z]+)*(?![{_WORD}])"


def entities(text: Column) -> Column:
    """The first five different capitalised phrases of more than two letters, in order; empty for null."""
    found = F.filter(F.regexp_extract_all(text, F.lit(PHRASE), 0), lambda x: F.length(x) > 2)
    return F.coalesce(F.slice(F.array_distinct(found), 1, ENTITIES), F.array().cast("array<string>"))


def search_terms(text: Column) -> Column:
    """Up to six terms: four entities, then the words that are no noise, each once whatever its case."""
    names = F.slice(entities(text), 1, ENTITY_TERMS)
    named = F.filter(names, lambda x, i: F.array_position(F.transform(names, F.lower), F.lower(x)) == i + 1)
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), 0), lambda w: F.regexp_replace(F.lower(w), r"^[?.,!]+|[?.,!]+$", ""))
    lowered = F.transform(named, F.lower)
    rest = F.filter(F.array_distinct(words), lambda w: (F.length(w) > 2) & ~w.isin(*NOISE) & ~F.array_contains(lowered, w))
    return F.slice(F.concat(named, rest), 1, TERMS)


def substrings(label: Column, least: int = 3) -> Column:
    """All different substrings of a label's runs of a-z, of ``least`` letters or more.

    Their number grows with the square of a run, so this is for labels and
    addresses, whose runs are short, not for texts.
    """
    of_run = lambda r: F.flatten(
        F.transform(F.sequence(F.lit(1), F.length(r) - least + 1), lambda i: F.transform(F.sequence(F.lit(least), F.length(r) - i + 1), lambda n: F.substring(r, i, n)))
    )
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(F.lower(label), F.lit(f"[a-z]{{{least},}}"), 0), of_run)))


def contained(needles: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """(needle, label): the needles (a-z only) that are part of a label, as an equi-join on substrings.

    ``needles`` has a column ``needle``, ``labels`` a column ``label``; needles
    shorter than ``least`` and nulls match nothing, repeated rows give one.
    """
    parts = labels.select("label").distinct().select("label", F.explode(substrings(F.col("label"), least)).alias("needle"))
    return parts.join(needles.select("needle").distinct(), "needle").select("needle", "label")


def cache_state(writes: DataFrame, key: str, at: str, order: str, kept: int = 100) -> DataFrame:
    """One row per key with the entries that its cache holds after the last write.

    A write comes last in its key's list, of which the newest ``kept`` stay,
    and keeps the list alive for an hour; a later write begins a new one.
    Where a key's last list begins is found from one row per key and hour (two
    writes of one hour are never an hour apart), so a hot key is aggregated
    before it moves.  Rows whose key or time is null take no part.
    """
    rows = writes.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, order)
    hours = rows.groupBy(key, F.date_trunc("hour", at).alias("hour")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    before = F.lag("last").over(Window.partitionBy(key).orderBy("hour"))
    begins = hours.select(key, "first", before.alias("before")).where(F.col("before").isNull() | (F.col("first") - F.col("before") > F.expr("INTERVAL 1 HOUR")))
    lists = begins.groupBy(key).agg(F.max("first").alias("begin"))
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(order)))
    last = rows.join(lists, key).where(F.col(at) >= F.col("begin")).withColumn("back", back).where(F.col("back") <= kept)
    return last.groupBy(key).agg(F.count("*").alias("entries"), F.min(at).alias("oldest"), F.max(at).alias("newest"))


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """Each query's ``k`` hits of highest score, ranked anew; ties go to the smaller id.

    ``score`` is any column expression over the hits: a model's, or the
    similarity that they came with.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def structured_context(content: Column) -> Column:
    """The short context of a product's record: title, price with currency, availability; its first 400 characters where it has one of them at most."""
    part = lambda pattern, i=1: F.nullif(F.trim(F.regexp_extract(content, pattern, i)), F.lit(""))
    price = r"(?i)Price:\s*([\d,]+\.?\d*)\s*(BDT|USD|৳|\$)?"
    amount = F.nullif(F.replace(part(price), F.lit(","), F.lit("")), F.lit(""))
    fields = F.array_compact(F.array(
        F.concat(F.lit("Product: "), part(r"(?m)Product:\s*(.+)$")), F.concat(F.lit("Price: "), amount, F.lit(" "), F.coalesce(part(price, 2), F.lit("BDT"))), F.concat(F.lit("Availability: "), part(r"(?m)Availability:\s*(.+)$")),
    ))
    return F.array_join(F.when(F.size(fields) <= 1, F.concat(fields, F.array(F.substring(F.coalesce(content, F.lit("")), 1, 400)))).otherwise(fields), "\n")


# --- Fixed values: words that ask to compare, to recommend, and for what fits together.
COMPARE, RECOMMEND, MATCH = ("vs", "versus", "compare", "difference", "better"), ("similar", "like", "recommend", "alternative", "other"), ("goes with", "pairs with", "compatible", "match")


def reasoning_kind(text: Column, names: Column) -> Column:
    """How the graph answers a question: none without entities, a comparison of two, a recommendation, compatibility, or what is related."""
    has = lambda words: F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))
    return F.when(F.size(names) == 0, "none").when((F.size(names) >= 2) & has(COMPARE), "comparison").when(has(RECOMMEND), "recommendation").when(has(MATCH), "compatibility").otherwise("related")


def safe_select(statement: Column, tables: list[str]) -> Column:
    """Whether a statement is a SELECT without a changing verb that names only the given tables; false for null."""
    named = F.transform(F.regexp_extract_all(statement, F.lit(r"(?i)\b(?:FROM|JOIN)\s+(\w+)"), 1), F.lower)
    changing = statement.rlike(r"(?i)\b(DROP|DELETE|UPDATE|INSERT|ALTER|CREATE|TRUNCATE|EXEC|EXECUTE|GRANT|REVOKE)\b")
    return F.coalesce(~changing & F.trim(statement).rlike("(?i)^SELECT") & F.forall(named, lambda t: t.isin(*(x.lower() for x in tables))), F.lit(False))


def within_budget(steps: Column, costs: dict[str, int], budget: int, unknown: int = 3) -> Column:
    """The steps, in order, that a budget pays for: one that costs more than is left is passed over."""
    prices = F.create_map(*(F.lit(x) for pair in costs.items() for x in pair))
    start = F.struct(F.lit(0).alias("spent"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        after = state["spent"] + F.coalesce(F.try_element_at(prices, x), F.lit(unknown))
        taken = F.struct(after.alias("spent"), F.concat(state["kept"], F.array(x)).alias("kept"))
        return F.when(after <= budget, taken).otherwise(state)

    return F.aggregate(steps, start, step, lambda s: s["kept"])
