"""Text classifiers as Column expressions: they run inside the scan's stage, without Python."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions import vocabulary as V


def word(alternatives: str) -> str:
    """A pattern for whole words, with ASCII borders so that all engines agree."""
    return rf"(^|[^A-Za-z0-9_])({alternatives})([^A-Za-z0-9_]|$)"


def contains_any(text: Column, phrases) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in phrases])


def matched(text: Column, phrases) -> Column:
    """The phrases that occur, in the list's order."""
    return F.filter(F.array(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases]), lambda x: x.isNotNull())


def matched_patterns(text: Column, patterns) -> Column:
    """How many of the patterns match."""
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a fixed phrase."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def pii_counts(text: Column) -> dict[str, Column]:
    return {kind: F.regexp_count(text, F.lit(f"(?i){p}")) for kind, p in V.PII.items()}


def redact(text: Column) -> Column:
    """Personal data replaced by its kind, kind after kind."""
    for kind, p in V.PII.items():
        text = F.regexp_replace(text, f"(?i){p}", f"[REDACTED_{kind.upper()}]")
    return text


def jailbreak_hits(text: Column, lookahead: bool = True) -> Column:
    return matched_patterns(F.lower(text), [*V.JAILBREAK, *(V.LOOKAHEAD if lookahead else ()), *V.INJECTION])


def moderation(text: Column) -> dict[str, Column]:
    lower = F.lower(text)
    words, topics = matched(lower, V.UNSAFE_WORDS), matched(lower, V.SENSITIVE_TOPICS)
    return {"n_words": F.size(words), "n_topics": F.size(topics), "severity": F.when(F.size(topics) > 0, "critical").when(F.size(words) > 0, "high").otherwise("low")}


def compliance(text: Column) -> dict[str, Column]:
    lower = F.lower(text)
    hits = {rule: contains_any(lower, phrases) for rule, (_, phrases) in V.COMPLIANCE.items()}
    high = reduce(or_, [h for rule, h in hits.items() if V.COMPLIANCE[rule][0] == "high"])
    some = reduce(or_, hits.values())
    return {**hits, "severity": F.when(high, "high").when(some, "medium").otherwise("low")}


def fraud_score(text: Column) -> Column:
    return F.least(F.lit(100.0), matched_patterns(F.lower(text), V.FRAUD) * V.FRAUD_POINTS)


def combined_risk(scores: dict[str, Column]) -> Column:
    """Weighted mean of the scores given, weights renormalised, at most 100."""
    total = sum(V.RISK_WEIGHTS.get(k, 0.1) for k in scores)
    return F.least(F.lit(100.0), sum((s * V.RISK_WEIGHTS.get(k, 0.1) for k, s in scores.items()), F.lit(0.0)) / total)


def risk_level(score: Column) -> Column:
    out = F.lit("low")
    for least, name in reversed(V.RISK_BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def contradiction(text: Column) -> Column:
    lower = F.lower(text)
    n = sum((occurrences(lower, w) for w in V.CONTRAST_WORDS), F.lit(0))
    score = F.when(n > 3, 0.5).when(n > 1, 0.25).otherwise(0.0)
    for positive, negative in V.NEGATIONS:
        score = score + F.when(F.contains(lower, F.lit(positive)) & F.contains(lower, F.lit(negative)), 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def language_confidence(text: Column) -> Column:
    lower = F.lower(text)
    over = sum((occurrences(lower, w) for w in V.OVERCONFIDENT), F.lit(0))
    hedged = sum((occurrences(lower, w) for w in V.HEDGES), F.lit(0))
    share = F.try_divide(hedged, over + hedged)
    return F.when(over + hedged == 0, 0.7).when((share >= 0.3) & (share <= 0.7), 0.9).when(share < 0.3, 0.4).otherwise(0.5)


def hallucination_score(contradicted: Column, confidence: Column) -> Column:
    return F.least(F.lit(100.0), F.when(contradicted > 0.4, contradicted * 30).otherwise(0.0) + F.when(confidence < 0.5, (1 - confidence) * 30).otherwise(0.0))


def hallucination_level(score: Column) -> Column:
    return F.when(score > 75, "high").when(score > 50, "medium").when(score > 25, "low").otherwise("minimal")


def request_class(query: Column) -> Column:
    """The kind of a chat request; greetings are tested by prefix, the others by substring."""
    lower = F.trim(F.lower(query))
    greets = reduce(or_, [F.startswith(lower, F.lit(g)) for g in V.GREETINGS])
    out = F.when(greets & (F.length(query) < 40), "greeting").when(contains_any(lower, V.SMALL_TALK) & (F.length(query) < 60), "small_talk").when(contains_any(lower, V.IDENTITY), "identity")
    for name, phrases in V.REQUEST_CLASSES.items():
        test = contains_any(lower, phrases)
        out = out.when(test | F.endswith(lower, F.lit("?")) if name == "faq" else test, name)
    return out.otherwise("general")


def product_intent(query: Column) -> Column:
    lower = F.lower(query)
    return (
        F.when(lower.rlike(word(V.COMPARISON)), "comparison").when(contains_any(lower, V.POLICY_WORDS), "policy_lookup").when(contains_any(lower, V.SUPPORT_WORDS), "support")
        .when(lower.rlike(word(V.PRICE_WORDS)), "price_query").when(lower.rlike(word(V.STOCK_WORDS)), "availability_query").when(lower.rlike(word(V.SHOP_WORDS)), "product_search")
        .when(lower.rlike(word(V.QUESTION_WORDS)), "faq").otherwise("general")
    )


def price_limit(query: Column, pattern: str) -> Column:
    found = F.regexp_replace(F.regexp_extract(F.lower(query), pattern, 1), ",", "")
    return F.when(found != "", found.try_cast("long"))


def constraints(query: Column) -> dict[str, Column]:
    lower = F.lower(query)
    first = lambda words: F.nullif(F.regexp_extract(lower, word(words), 2), F.lit(""))
    return {"price_max": price_limit(query, V.PRICE_MAX), "price_min": price_limit(query, V.PRICE_MIN), "size": F.upper(first(V.SIZES)), "color": first(V.COLORS)}


def ambiguity(query: Column) -> Column:
    """pronoun_only, too_short, multi_meaning or null, for a query without history."""
    lower = F.trim(F.lower(query))
    few = F.size(F.filter(F.split(lower, r"\s+"), lambda w: w != "")) <= 3
    out = F.when(lower.rlike(V.PRONOUN_ONLY), "pronoun_only").when(lower.rlike(V.TOO_SHORT), "too_short")
    return out.when(few & reduce(or_, [lower.rlike(word(t)) for t in V.MULTI_MEANING]), "multi_meaning")


def correct_typos(query: Column) -> Column:
    """Known misspellings replaced, word by word; single spaces between words."""
    known = F.create_map(*[F.lit(x) for pair in V.TYPOS.items() for x in pair])
    fix = lambda w: F.coalesce(F.try_element_at(known, F.regexp_replace(F.lower(w), "[^a-z]", "")), w)
    return F.array_join(F.transform(F.filter(F.split(query, r"\s+"), lambda w: w != ""), fix), " ")


def context_budget(query: Column) -> Column:
    """A model's tokens by the four-characters rule, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(query) / 4).cast("int"))


def chunk_type(chunk: Column) -> Column:
    return (
        F.when(chunk.rlike(r"(?i)^Q:\s*[^\n]+"), "faq").when(chunk.rlike(r"[^\n]\|[^\n]"), "table").when(chunk.rlike("Price:|SKU:|Brand:|Availability:"), "product_spec")
        .when(chunk.rlike(r"#{1,6}\s"), "documentation").otherwise("text")
    )


def unescape(text: Column) -> Column:
    for entity, char in V.ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_markdown(text: Column) -> Column:
    for pattern, to in ((r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\*{1,3}([^*\n]+)\*{1,3}", "$1"), (r"_{1,2}([^_\n]+)_{1,2}", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"`([^`]+)`", "$1"), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def page_kind(text: Column, url: Column) -> dict[str, Column]:
    lower = F.lower(text)
    product, pricing = matched_patterns(lower, V.PRODUCT_SIGNALS), matched_patterns(lower, V.PRICING_SIGNALS)
    priced = (pricing >= 2) | contains_any(F.lower(url), ("pricing", "plans"))
    return {"product_hits": product, "pricing_hits": pricing, "kind": F.when(priced, "pricing").when(product >= 2, "product").otherwise("general")}


def address_priority(url: Column) -> Column:
    lower, out = F.lower(url), None
    for segment, p in V.ADDRESS_PRIORITY.items():
        test = F.contains(lower, F.lit(f"/{segment}/")) | F.endswith(lower, F.lit(f"/{segment}"))
        out = F.when(test, p) if out is None else out.when(test, p)
    return out.otherwise(V.DEFAULT_PRIORITY)


def skipped_address(url: Column) -> Column:
    return contains_any(F.lower(url), V.SKIPPED_ADDRESSES)


def canonical_address(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no trailing slash, tracking parameters gone, the rest sorted by name (first value of each)."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head, tail = F.split_part(bare, F.lit("?"), F.lit(1)), F.when(F.contains(bare, F.lit("?")), F.substring_index(bare, "?", -1)).otherwise(F.lit(""))
    origin = F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    path = F.regexp_replace(F.substring(head, F.length(origin) + 1, F.lit(1 << 20)), "/+$", "")
    kept = F.filter(F.split(tail, "&"), lambda p: F.contains(p, F.lit("=")) & ~F.endswith(p, F.lit("=")) & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*V.TRACKING_PARAMETERS))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(F.lower(origin), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
