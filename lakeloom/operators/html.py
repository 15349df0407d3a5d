"""Extraction from HTML: patterns for single fields, and a parser for blocks."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.classify import unescape

_SKIP = {"script", "style", "nav", "footer", "header", "aside", "noscript"}
_BLOCK = {"p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "br", "details", "summary", "title"}


def first_tag(html: Column, tag: str) -> Column:
    """The text of the first element of a kind, tags and entities resolved."""
    return F.trim(unescape(F.regexp_replace(F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", "")))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; single spaces."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(bare, "<[^>]*>", " ")), r"\s+", " "))


class _Page(HTMLParser):
    """Collects headings, blocks of text with their share of link text, table rows, questions and JSON-LD."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.headings, self.blocks, self.rows, self.data = "", [], [], [], []
        self._open: list[str] = []
        self._text, self._linked, self._row, self._json = "", 0, None, None

    def _end_block(self) -> None:
        text = " ".join(self._text.split())
        if text:
            self.blocks.append((text, self._linked / max(1, len(text))))
        self._text, self._linked = "", 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _BLOCK:
            self._end_block()
        if tag == "script" and dict(attrs).get("type") == "application/ld+json":
            self._json = ""
        if tag == "tr":
            self._row = []
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            self._open.append(tag)

    def handle_endtag(self, tag) -> None:
        if self._json is not None and tag == "script":
            self.data.append(self._json)
            self._json = None
        text = " ".join(self._text.split())
        if tag == "title":
            self.title, self._text = text, ""
        if tag in ("h1", "h2", "h3") and text:
            self.headings.append(text)
        if tag in ("td", "th") and self._row is not None:
            self._row.append(text)
            self._text = ""
        if tag == "tr" and self._row:
            self.rows.append(" | ".join(self._row))
            self._row = None
        if tag in _BLOCK:
            self._end_block()
        if tag in self._open:
            while self._open.pop() != tag:
                pass

    def handle_data(self, data) -> None:
        if self._json is not None:
            self._json += data
        elif not _SKIP & set(self._open):
            self._text += data
            if "a" in self._open:
                self._linked += len(data.strip())


def parse_page(html: str | None) -> dict:
    """Title, headings, main text (blocks that are mostly not links), table rows, and products of JSON-LD."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page._end_block()
    products = []
    for raw in page.data:
        try:
            found = json.loads(raw)
        except ValueError:
            continue  # a broken block is no data
        for x in found if isinstance(found, list) else found.get("@graph", [found]) if isinstance(found, dict) else []:
            if isinstance(x, dict) and "Product" in str(x.get("@type")):
                offers = x.get("offers") or {}
                offers = offers if isinstance(offers, list) else [offers]
                prices = [float(o["price"]) for o in offers if isinstance(o, dict) and str(o.get("price", "")).replace(".", "", 1).isdigit()]
                products.append({"name": x.get("name"), "sku": x.get("sku"), "price": min(prices, default=None)})
    seen, lines = set(), []
    for text, links in page.blocks:
        if links < 0.5 and (len(text) >= 100 or text not in seen):
            lines.append(text)
        seen.add(text)
    return {"title": page.title, "headings": page.headings[:20], "content": "\n".join(lines), "rows": page.rows, "products": [p for p in products if p["name"]]}


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, headings, content, rows, products) of (page_id, html)."""
    schema = "page_id long, title string, headings array<string>, content string, rows array<string>, products array<struct<name:string,sku:string,price:double>>"
    product = pa.struct([("name", pa.string()), ("sku", pa.string()), ("price", pa.float64())])
    kinds = {"title": pa.string(), "headings": pa.list_(pa.string()), "content": pa.string(), "rows": pa.list_(pa.string()), "products": pa.list_(product)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_page(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], t) for k, t in kinds.items()]], names=["page_id", *kinds])

    return pages.select("page_id", "html").mapInArrow(run, schema)
