"""Cleaning of scraped texts and widening of keyword queries, in Arrow batch functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values: what is noise anywhere, which lines are navigation, which are labels, prices, and the characters kept.
NOISE = (r"[\w\.-]+@[\w\.-]+\.\w+", r"(?i:cookie\s*(policy|consent|banner))", r"(?i:accept\s+all\s+cookies)", r"(?i:privacy\s+policy\s*\|)", r"(?i:©\s*\d{4}.*?rights\s+reserved)", r"(?i:powered\s+by\s+\w+)")
NAVIGATION = ("home", "menu", "navigation", "skip to", "back to top", "read more", "learn more", "click here", "subscribe", "follow us", "share", "tweet", "pin it", "like", "comment")
LABELS = (
    "material", "materials", "fabric", "composition", "care", "wash", "shipping", "delivery", "return", "exchange", "refund", "feature", "features", "description", "detail", "details",
    "dimension", "dimensions", "weight", "warranty", "sku", "barcode", "brand", "type", "tag", "tags",
)
CURRENCY = "৳$£€¥₹"
KEPT = r"[^\w\s.,!?;:()/\-'\"$%#+@&|ঀ-৿؀-ۿ一-鿿৳₦-⃏£€¥\n]"
SHORT, REPEATED, HEADING = 10, 100, 40

# --- Fixed values: groups of words that mean nearly the same; a word stands for the last group that lists it.
SYNONYMS = {
    "tshirt": ("tshirt", "t-shirt", "tee", "shirt", "topwear", "top"), "shirt": ("shirt", "tshirt", "t-shirt", "top", "topwear"), "hoodie": ("hoodie", "sweatshirt", "pullover", "fleece", "hooded"),
    "pant": ("pant", "pants", "trouser", "trousers", "bottom", "lower"), "shorts": ("shorts", "short pant", "half pant", "bermuda"), "jacket": ("jacket", "coat", "outerwear", "windbreaker", "blazer"),
    "dress": ("dress", "frock", "gown", "maxi"), "saree": ("saree", "sari", "sharee"), "kurta": ("kurta", "panjabi", "punjabi", "tunic"), "shoe": ("shoe", "shoes", "footwear", "sneaker", "trainer", "boot"),
    "bag": ("bag", "backpack", "handbag", "purse", "tote"), "cotton": ("cotton", "cot", "100% cotton", "pure cotton"), "polyester": ("polyester", "poly", "synthetic", "microfiber"),
    "denim": ("denim", "jeans", "jean fabric"), "linen": ("linen", "linen fabric", "breathable fabric"), "waterproof": ("waterproof", "water resistant", "water repellent", "rain proof"),
    "breathable": ("breathable", "air flow", "ventilated", "moisture wicking"), "stretchable": ("stretchable", "stretch", "elastic", "flexible", "4-way stretch"),
    "slim fit": ("slim fit", "slim", "fitted", "skinny fit"), "regular fit": ("regular fit", "regular", "standard fit", "classic fit"), "oversized": ("oversized", "loose fit", "baggy", "relaxed fit"),
    "black": ("black", "dark", "jet black", "charcoal"), "white": ("white", "off white", "cream", "ivory"), "navy": ("navy", "navy blue", "dark blue", "midnight blue"), "grey": ("grey", "gray", "charcoal grey", "ash"),
    "return": ("return", "exchange", "refund", "return policy"), "shipping": ("shipping", "delivery", "dispatch", "courier"), "discount": ("discount", "sale", "offer", "promo", "deal", "coupon"),
    "available": ("available", "in stock", "stock", "availability"), "price": ("price", "cost", "rate", "amount", "charge"), "size": ("size", "sizing", "measurement", "dimension", "fit"),
    "variant": ("variant", "variation", "option", "color", "size option"), "material": ("material", "fabric", "composition", "textile", "cloth"), "warranty": ("warranty", "guarantee", "quality assurance"),
    "care": ("care", "wash", "washing", "maintenance", "cleaning"),
}

_NOISE = re.compile("|".join(NOISE))
_NAVIGATION = re.compile("(?:" + "|".join(NAVIGATION) + ")$", re.I)
_PRICE = re.compile(rf"\d[\d.,]*\s*[{CURRENCY}]|[{CURRENCY}]\s*\d")
_DROPPED, _RUNS, _BREAKS = re.compile(KEPT), re.compile(r"[ \t]{2,}"), re.compile(r"\n{3,}")
_THOUSANDS, _BELOW, _RANGE = re.compile(r"(under|below)\s+(\d+)k", re.I), re.compile(r"under\s+(\d+)", re.I), re.compile(r"(\d+)\s*-\s*(\d+)\s*tk", re.I)


def _worth_keeping(line: str) -> bool:
    """Tables, questions and answers, prices, lines of some length, and short headings."""
    return "|" in line or line.startswith(("Q:", "A:", "FAQ")) or bool(_PRICE.search(line)) or len(line) > SHORT or (line[0].isupper() and len(line) < HEADING)


def clean_text(text: str | None) -> str:
    """A scraped text without noise, navigation and short repeated lines, with labels and their values on one line."""
    kept: list[str] = []
    seen: set[str] = set()
    for line in map(str.strip, _NOISE.sub(" ", text or "").split("\n")):
        key = " ".join(line.lower().split())
        if not line or (key in seen and len(line) < REPEATED):
            continue
        seen.add(key)
        if not _NAVIGATION.match(line) and _worth_keeping(line):
            kept.append(line)
    out: list[str] = []
    for line in kept:
        waiting = bool(out) and out[-1].lower() in LABELS  # a label that has no value yet; a merged line is no label
        if waiting and line.lower() not in LABELS and len(line) > 3:
            out[-1] = f"{out[-1]}: {line}"
        else:
            out.append(line)
    joined = _BREAKS.sub("\n\n", _RUNS.sub(" ", "\n".join(out)))
    return _RUNS.sub(" ", _DROPPED.sub(" ", joined)).strip()


def expand_query(text: str | None) -> str | None:
    """A keyword query with prices spelt out and one new synonym for each group of words it names."""
    if not text or not text.strip():
        return text
    q = text.lower().strip()
    for word, other in (("under", "below"), ("below", "under")):
        q = _THOUSANDS.sub(lambda m, w=word, o=other: f"{w} {int(m[2]) * 1000} price {o} {int(m[2]) * 1000} BDT" if m[1] == w else m[0], q)
    q = _BELOW.sub(r"under \1 price below \1 BDT", q)
    q = _RANGE.sub(r"price \1 to \2 BDT taka", q)
    group_of = {s: g for g, words in SYNONYMS.items() for s in words}
    groups = dict.fromkeys(group_of[w] for w in re.findall(r"[a-z0-9\-]+", q) if w in group_of)
    for g in groups:
        new = next((s for s in SYNONYMS[g] if s not in q), None)
        q = f"{q} {new}" if new else q
    return " ".join(q.split())


def map_column(df: DataFrame, text_col: str, function, name: str) -> DataFrame:
    """``df`` with one more text column made by a Python function of another, a batch at a time."""

    @F.arrow_udf("string")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            yield pa.array([function(t) for t in texts.to_pylist()], pa.string())

    return df.withColumn(name, run(F.col(text_col).cast("string")))
