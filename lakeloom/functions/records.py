"""The labelled fields of a product's record text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of lines, whether their case counts, and labels of blocks with what ends them.
LINES = {
    "title": ("Product", True), "availability": ("Availability", True), "brand": ("Brand", True), "sku": ("SKU", True), "product_type": ("Type", True), "material": ("Material", False),
    "color": ("Color", False), "size_options": ("(?:Size|Sizes|Size Options)", False), "tags": ("Tags", True),
}
PRICE_LINE, NUMBER, CURRENCY = "Price", r"\d+\.?\d*", r"(BDT|USD|GBP|EUR|INR|৳|\$|£|€)"
BLOCKS = {
    "description": ("Description", ("Variants:", "Shipping:", "Return", "Care")),
    "shipping_info": ("Shipping", ("Return", "Care", "Variants:")),
    "return_policy": ("Return Policy", ("Care", "Variants:")),
    "care_instructions": ("Care Instructions", ("Variants:",)),
    "variants": ("Variants", ("Shipping:", "Return", "Care")),
}
# End of the fixed values.


def line_pattern(label: str, exact: bool = True) -> str:
    return f"(?m{'' if exact else 'i'})^{label}:\\s*(.+)$"


def block_pattern(label: str, ends: tuple[str, ...]) -> str:
    return f"(?s){label}:\\s*\\n(.*?)(?:{'|'.join(chr(92) + 'n' + e for e in ends)}|\\z)"


def _found(content: Column, pattern: str) -> Column:
    """The first group, without blanks around it; null if there is no match or nothing in it."""
    # Lines end at \n alone.
    text = F.btrim(F.regexp_extract(content, "(?d)" + pattern, 1), F.lit(" \t\n\r\x0b\x0c"))
    return F.when(text != "", text)


def record_fields(content: Column) -> Column:
    """A struct of the fields of a record text: nine lines, price and currency, and five blocks (``variants`` as its text).

    The first line of each label counts.  A field that the text doesn't have, or
    that is blank, is null; a null text has none.
    """
    price = _found(content, line_pattern(PRICE_LINE))
    number = F.regexp_extract(F.replace(price, F.lit(",")), NUMBER, 0)
    currency = F.regexp_extract(price, CURRENCY, 1)
    lines = [_found(content, line_pattern(*x)).alias(name) for name, x in LINES.items()]
    blocks = [_found(content, block_pattern(*x)).alias(name) for name, x in BLOCKS.items()]
    return F.struct(*lines, F.when(number != "", number.cast("double")).alias("price"), F.when(currency != "", currency).alias("currency"), *blocks)
