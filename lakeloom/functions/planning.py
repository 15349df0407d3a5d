"""Retrieval plans of questions, governance decisions and record texts, as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions import classify as C
from lakeloom.functions import vocabulary as V

#: Words that keyword search leaves out; routes as (test, route, top_k, threshold), the first that holds counts.
NOISE = ("please", "can", "you", "tell", "me", "about", "show", "give", "what", "is", "the", "are", "does", "do", "a", "an", "of")
SIMPLE_FIELDS = "how much|price|cost|available|in stock|out of stock|availability|material|fabric|sku|shipping|delivery|return|exchange|refund|size|sizes|color|colour|colors|colours|weight|dimension|brand"
LEAK_WORDS = ("password", "api_key", "secret", "token", "credential")
PLATFORMS = (("shopify", ("shopify.theme", "/cdn/shop/")), ("woocommerce", ("woocommerce",)), ("wordpress", ("wp-content", "wp-includes")), ("nextjs", ("__next_f", "_next/static")), ("magento", ("magento", "mage/cookies")), ("gitbook", ("gitbook",)), ("zendesk", ("zendesk",)), ("discourse", ("discourse",)))
LOCATIONS = "dhaka|chittagong|ctg|sylhet|khulna|rajshahi|gulshan|dhanmondi|mirpur"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def keyword_query(text: Column) -> Column:
    """Lower case, closing punctuation and noise words gone; all words where nothing would be left."""
    w = words(F.regexp_replace(F.lower(F.trim(text)), r"[?!.]+$", ""))
    kept = F.filter(w, lambda x: ~x.isin(*NOISE))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(w), " ")


def route(intent: Column, has_sku: Column, has_entities: Column, n_words: Column) -> Column:
    """struct(route, top_k, threshold) for a question."""
    plan = lambda name, k, t: F.struct(F.lit(name).alias("route"), F.lit(k).alias("top_k"), F.lit(t).alias("threshold"))
    return (
        F.when(has_sku, plan("BM25_ONLY", 5, 0.0)).when(intent.isin("order_lookup", "inventory_check"), plan("TOOL", 0, 0.0)).when(intent == "comparison", plan("GRAPH", 10, 0.3))
        .when(intent.isin("price_query", "availability_query"), plan("STRUCTURED", 8, 0.25)).when(intent.isin("policy_lookup", "faq"), plan("HYBRID", 6, 0.25))
        .when(intent.isin("product_search", "general") & has_entities, plan("HYBRID", 8, 0.25)).when(n_words <= 3, plan("VECTOR_ONLY", 5, 0.35)).otherwise(plan("HYBRID", 6, 0.25))
    )


def context_limits(text: Column, n_words: Column) -> Column:
    """struct(chunks, chars): how much context a question gets."""
    size = lambda n, c: F.struct(F.lit(n).alias("chunks"), F.lit(c).alias("chars"))
    return F.when(F.lower(text).rlike(C.word(SIMPLE_FIELDS)), size(2, 800)).when(n_words <= 3, size(2, 500)).when(n_words <= 8, size(3, 800)).otherwise(size(4, 1000))


def model(kind: Column, risk: Column) -> Column:
    return F.when(risk.isin("high", "critical") | (kind == "reasoning"), "large").otherwise("small")


def facts(text: Column) -> Column:
    """What a message tells of its author: name, order, payment and place; array of 'kind=value'."""
    name = F.regexp_extract(text, r"(?i)(?:my name is|i am|i'm|call me)\s+([a-z]+)", 1)
    order = F.regexp_extract(F.upper(text), r"(ORD-?\d{4,}|ORDER\s+#?\d{4,})", 1)
    lower = F.lower(text)
    place = F.regexp_extract(lower, C.word(LOCATIONS), 2)
    found = F.array(
        F.when(name != "", F.concat(F.lit("name="), F.lower(name))), F.when(order != "", F.concat(F.lit("order="), order)),
        F.when(C.contains_any(lower, ("cash on delivery", "cod")), F.lit("payment=cash on delivery")), F.when(place != "", F.concat(F.lit("place="), place)),
    )
    return F.filter(found, lambda x: x.isNotNull())


def decision(text: Column, lookahead: bool = True) -> Column:
    """struct(action, level, flags): jailbreak first, then moderation, personal data and compliance."""
    jail = C.jailbreak_hits(text, lookahead) > 0
    lower = F.lower(text)
    topics, unsafe = C.contains_any(lower, V.SENSITIVE_TOPICS), C.contains_any(lower, V.UNSAFE_WORDS)
    pii = C.matched_patterns(text, ["(?i)" + p for p in V.PII.values()]) > 0
    broken = {rule: C.contains_any(lower, p) for rule, (_, p) in V.COMPLIANCE.items()}
    high = reduce(or_, [b for r, b in broken.items() if V.COMPLIANCE[r][0] == "high"])
    flags = F.filter(F.array(F.when(unsafe, "unsafe_content"), F.when(pii, "pii_detected"), *[F.when(b, r) for r, b in broken.items()]), lambda x: x.isNotNull())
    out = lambda action, level, f: F.struct(F.lit(action).alias("action"), F.lit(level).alias("level"), f.alias("flags"))
    return (
        F.when(jail, out("block", "critical", F.array(F.lit("jailbreak_detected")))).when(topics, out("block", "critical", F.array(F.lit("unsafe_content"))))
        .when(unsafe, out("warn", "high", flags)).when(pii & high, out("warn", "medium", flags)).when(pii, out("allow", "medium", flags)).when(high, out("warn", "medium", flags)).otherwise(out("allow", "low", flags))
    )


def escalation(score: Column, fraud: Column, jailbroken: Column, violations: Column) -> Column:
    """The escalation rules that hold."""
    rules = F.array(F.when(score >= V.ESCALATION_SCORE, "high_risk_score"), F.when(fraud >= 75, "critical_fraud"), F.when(jailbroken, "jailbreak_attempt"), F.when(violations >= 3, "repeated_violations"))
    return F.filter(rules, lambda x: x.isNotNull())


def leak_score(text: Column) -> Column:
    return F.least(F.lit(100), C.matched_patterns(F.lower(text), LEAK_WORDS) * 20)


def platform(html: Column) -> Column:
    lower, out = F.lower(html), None
    for name, marks in PLATFORMS:
        test = C.contains_any(lower, marks)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("generic")


def policy_violations(rules: list[dict], columns: dict[str, Column]) -> Column:
    """Names of declarative rules that a record breaks.

    A rule has ``name``, ``field`` and one of ``required`` (true), ``max_length``
    (a number), ``forbidden`` (a list of phrases) or ``pattern`` (must match).
    """
    checks = []
    for r in rules:
        c = columns[r["field"]]
        if r.get("required"):
            broken = c.isNull() | (c == "")
        elif "max_length" in r:
            broken = F.length(c) > r["max_length"]
        elif "forbidden" in r:
            broken = C.contains_any(F.lower(c), r["forbidden"])
        elif "pattern" in r:
            broken = ~c.rlike(r["pattern"])
        else:
            raise ValueError(f"rule {r.get('name')} checks nothing")
        checks.append(F.when(broken, F.lit(r["name"])))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def field(text: Column, label: str) -> Column:
    """The value of a 'Label: value' line, or null."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^{label}:[ \t]*([^\n]*)$", 1)), F.lit(""))


def variants(text: Column) -> Column:
    """The lines under 'Variants:' as structs of title, price, availability and stock code."""
    block = F.regexp_extract(text, r"(?s)Variants:[ \t]*\n(.*?)(\nShipping:|\nReturn|\nCare|$)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.trim(x) != "")

    def parse(x: Column) -> Column:
        bare = F.regexp_replace(F.trim(x), r"^[- ]+", "")
        sku = F.regexp_extract(bare, r"SKU: *([^\s,]+)", 1)
        price = F.regexp_replace(F.regexp_extract(bare, r": *([\d,]+\.?\d*)", 1), ",", "").try_cast("double")
        title = F.trim(F.regexp_extract(bare, r"^([^:]*)", 1))
        return F.struct(title.alias("title"), F.coalesce(price, F.lit(0.0)).alias("price"), (~F.contains(bare, F.lit("Out of Stock"))).alias("available"), sku.alias("sku"))

    return F.transform(lines, parse)
