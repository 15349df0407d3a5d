"""Product data in the state that a page's scripts start from.

A page may carry its data as JSON: in a script of a framework, in an assignment to
a ``window`` property, or in plain JSON blocks.  Every state is read, and the
product that says most is taken.  The shape of the JSON isn't known, so a product
is searched for: the first node, depth first, with a name and a sign of sale.

One row a page.  A null or empty page, or one without a product, has nulls and a
richness of 0.  Broken JSON is no state; text after a complete value is ignored.
A state of another shape than its framework's gives no product.  A price that
isn't a number is null.  Ties in richness go to the earlier pattern, then block.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

# What states look like, in the order in which they are tried.
_GLOBAL = r"window\.%s\s*=\s*(\{.*?\})\s*;"
STATES = [
    ("nextjs", r"""<script[^>]*id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""),
    ("nuxt", _GLOBAL % "__NUXT__"),
    ("shopify_analytics", _GLOBAL % "ShopifyAnalytics"),
    ("shopify_theme", _GLOBAL % "product"),
    ("generic_state", _GLOBAL % "__(?:INITIAL_STATE|APP_STATE|STATE|REDUX_STATE|STORE_STATE)__"),
    ("redux_state", _GLOBAL % "__PRELOADED_STATE__"),
]
BLOCK = r"""<script[^>]+type=["']application/json["'][^>]*>(.*?)</script>"""
#: A product node has one of the names and one of the signs.
NAMES = ("title", "name")
SIGNS = ("price", "variants", "sku", "priceRange", "handle")
#: A field's keys; the first one that isn't empty counts.
KEYS = {
    "title": ("title", "name"),
    "handle": ("handle",),
    "sku": ("sku",),
    "brand": ("vendor", "brand"),
    "product_type": ("productType", "product_type"),
    "description": ("description", "body_html"),
    "material": ("material",),
    "color": ("color",),
}
#: Levels below the root, and items of a list, that are searched.
DEPTH, ITEMS = 8, 5
# End of the fixed values.

_STATES = [(kind, re.compile(pattern, re.S)) for kind, pattern in STATES]
_BLOCK = re.compile(BLOCK, re.S | re.I)
_DECODER = json.JSONDecoder()

VARIANT = "struct<sku:string,title:string,price:double,available:boolean,options:map<string,string>,barcode:string>"
SCHEMA = "page_id long, state string, richness int, " + ", ".join(f"{k} string" for k in KEYS) + f", price double, availability string, tags string, variants array<{VARIANT}>"
_TEXT = pa.string()
_ARROW = {
    "state": _TEXT, "richness": pa.int32(), **dict.fromkeys(KEYS, _TEXT), "price": pa.float64(), "availability": _TEXT, "tags": _TEXT,
    "variants": pa.list_(pa.struct([("sku", _TEXT), ("title", _TEXT), ("price", pa.float64()), ("available", pa.bool_()), ("options", pa.map_(_TEXT, _TEXT)), ("barcode", _TEXT)])),
}


def product_node(node: Any, depth: int = 0) -> dict | None:
    """The first product node, depth first, at most DEPTH levels below the root."""
    if depth > DEPTH or not node:
        return None
    if isinstance(node, dict):
        if any(node.get(k) for k in NAMES) and any(node.get(k) for k in SIGNS):
            return node
        below = node.values()
    elif isinstance(node, list):
        below = node[:ITEMS]
    else:
        return None
    return next((found for x in below if (found := product_node(x, depth + 1))), None)


def _of_next(state: dict) -> dict | None:
    props = state.get("props", {}).get("pageProps", {})
    named = props.get("product") or props.get("productData") or props.get("data", {}).get("product") or product_node(props)
    if isinstance(named, dict) and named:
        return named
    asked = (props.get("dehydratedState") or {}).get("queries", [])
    return next((found for q in asked if (found := product_node(q.get("state", {}).get("data", {})))), None)


def _of_nuxt(state: dict) -> dict | None:
    data = state.get("data", [])
    for x in data if isinstance(data, list) else [data]:
        if found := x.get("product") or product_node(x):
            return found
    return product_node(state.get("payload", {}))


def _of_shop(state: dict) -> dict | None:
    return state.get("meta", {}).get("product") or state.get("product") or state.get("data", {}).get("product")


_READERS = {"nextjs": _of_next, "nuxt": _of_nuxt, "shopify_analytics": _of_shop, "shopify_theme": _of_shop}


def _text(x: Any) -> str | None:
    return x if isinstance(x, str) or x is None else json.dumps(x, ensure_ascii=False)


def _number(x: Any) -> float | None:
    try:
        return float(str(x).replace(",", ""))
    except ValueError:
        return None


def _variant(v: dict) -> dict:
    chosen = [(f"option{i}", v.get(f"option{i}")) for i in (1, 2, 3)]
    options = {k: _text(x) for k, x in chosen if x}
    options |= {str(x.get("name", "")): _text(x.get("value", "")) for x in v.get("selectedOptions") or [] if isinstance(x, dict)}
    price = v.get("price", 0)
    price = price.get("amount", 0) if isinstance(price, dict) else price
    return {"sku": _text(v.get("sku", "")), "title": _text(v.get("title", "")), "price": _number(price or 0), "available": bool(v.get("available", v.get("availableForSale", True))), "options": options, "barcode": _text(v.get("barcode", ""))}


def normalised(node: dict) -> dict | None:
    """The fields of a product node under the names used here; None if there are fewer than two."""
    out: dict[str, Any] = {}
    for name, keys in KEYS.items():
        if value := next((node[k] for k in keys if node.get(k)), None):
            out[name] = _text(value)
    if (price := node.get("price") or node.get("price_min")) and (number := _number(price)) is not None:
        out["price"] = number
    stock = node.get("available") or node.get("availability")
    if isinstance(stock, bool):
        out["availability"] = "In Stock" if stock else "Out of Stock"
    elif isinstance(stock, str):
        out["availability"] = stock
    if tags := node.get("tags"):
        out["tags"] = ", ".join(map(str, tags)) if isinstance(tags, list) else str(tags)
    variants = node.get("variants")
    if isinstance(variants, list) and (variants := [_variant(v) for v in variants if isinstance(v, dict)]):
        out["variants"] = variants
    return out if len(out) > 1 else None


def richness(fields: dict) -> int:
    """Fields that say something, and two for each variant."""
    return sum(1 for v in fields.values() if v not in (None, "", [], {})) + 2 * len(fields.get("variants", ()))


def _states(html: str) -> Iterator[tuple[str, Any]]:
    """(kind, JSON value) of the first state of each kind and of all JSON blocks of more than one key."""
    for kind, pattern in _STATES:
        if m := pattern.search(html):
            try:
                yield kind, _DECODER.raw_decode(m[1].strip() if kind == "nextjs" else html[m.start(1) :])[0]
            except (ValueError, RecursionError):
                continue
    for m in _BLOCK.finditer(html):
        try:
            found = json.loads(m[1])
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict) and len(found) > 1:
            yield "embedded_json", found


def page_product(html: str | None) -> dict:
    """The richest product of a page's states, with the kind of its state; empty if there is none."""
    best: dict = {"richness": 0}
    for kind, state in _states(html or ""):
        try:
            node = _READERS.get(kind, product_node)(state)
        except (AttributeError, TypeError):  # a state of another shape
            continue
        fields = normalised(node) if isinstance(node, dict) and node else None
        if fields and richness(fields) > best["richness"]:
            best = {"state": kind, "richness": richness(fields), **fields}
    return best


def hydration_products(pages: DataFrame) -> DataFrame:
    """The product in the state of every page of (page_id, html): one row a page, see SCHEMA."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_product(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array([list_maps(f.get(k)) for f in found], t) for k, t in _ARROW.items())], names=["page_id", *_ARROW])

    return pages.select("page_id", "html").mapInArrow(run, SCHEMA)


def list_maps(value: Any) -> Any:
    """A field as Arrow takes it: the options of variants as pairs."""
    return [v | {"options": list(v["options"].items())} for v in value] if isinstance(value, list) else value
