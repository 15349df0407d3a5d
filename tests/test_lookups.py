"""Look-ups by part of a name, terms of questions, script addresses and cache states against plain Python."""

import datetime
import re

from pyspark.sql import functions as F

from lakeloom.functions.scripts import script_endpoints
from lakeloom.operators.lookup import COMPARE, MATCH, NOISE, RECOMMEND, cache_state, contained, entities, reasoning_kind, rerank, safe_select, search_terms, structured_context, within_budget
from lakeloom.plans.lookups import comparison_contexts  # noqa: F401  (the module registers its queries)

TEXTS = [None, "", "a", "Is the Red Shirt in stock? red shirt, Blue  Cap!", "Anéan Foo Bané Foo.Bar FOO foo The An", "What is the price of OnePlus and Nokia and Sony and Acer and Dell and Asus?", "x " * 50]


def plain_entities(text):
    found = [m.group(1) for m in re.finditer(r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\b", text or "")]
    return list(dict.fromkeys(x for x in found if len(x) > 2))[:5]


def plain_terms(text):
    terms = plain_entities(text)[:4]
    terms += [w for w in (x.lower().strip("?.,!") for x in (text or "").split()) if len(w) > 2 and w not in NOISE]
    kept, seen = [], set()
    for t in terms:
        if t.lower() not in seen:
            seen.add(t.lower())
            kept.append(t)
    return kept[:6]


def test_terms(spark):
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text").collect()]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", entities(F.col("text")).alias("e"), search_terms(F.col("text")).alias("t")).collect()
    for r in rows:
        assert r.e == plain_entities(texts[r.i]) and r.t == plain_terms(texts[r.i]), texts[r.i]


def test_contained(spark):
    needles, labels = ["abc", "bcd", "ab", "xyz", "abc", None], ["zabcd", "abc", "ab cd", "", None, "abc"]
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    got = sorted(tuple(r) for r in contained(frame(needles, "needle"), frame(labels, "label")).collect())
    assert got == sorted({(n, x) for n in needles for x in labels if n and x and len(n) > 2 and n in x})
    assert contained(frame([], "needle"), frame(labels, "label")).count() == 0


def test_cache_state(spark):
    start = datetime.datetime(2024, 1, 1)
    after = lambda minutes: start + datetime.timedelta(minutes=minutes)
    rows = [("a", after(m), i) for i, m in enumerate([0, 59, 119, 180, 239])]  # the pause of 61 minutes empties the list
    rows += [("b", after(i / 10), i) for i in range(150)] + [("b", after(14.9), 149)]  # more than fit, and a repeated row
    rows += [("c", after(0), 0), ("c", after(60), 1), (None, after(0), 0), ("d", None, 0)]  # an hour to the second is no pause
    got = {r.k: (r.entries, r.oldest, r.newest) for r in cache_state(spark.createDataFrame(rows, "k string, at timestamp_ntz, n int"), "k", "at", "n").collect()}
    assert got == {"a": (2, after(180), after(239)), "b": (100, after(5.1), after(14.9)), "c": (2, after(0), after(60))}


def test_script_endpoints(spark):
    script = """fetch('/api/cart'); x = "/api/items/list"; axios.get("https://c.example/api/stock"); fetch("data/all.json"); fetch('/api/cart')"""
    rows = spark.createDataFrame([(0, script, "https://a.example/shop/p1?x=/"), (1, None, "https://a.example"), (2, "fetch('data/b.json')", "https://a.example")], "i int, s string, u string")
    got = {r.i: r.e for r in rows.select("i", script_endpoints(F.col("s"), F.col("u")).alias("e")).collect()}
    assert got[0] == ["https://a.example/api/cart", "https://a.example/api/items/list", "https://c.example/api/stock", "https://a.example/shop/data/all.json"]
    assert got[1] == [] and got[2] == ["https://a.example/data/b.json"]


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 5, 0.5), (1, 4, 0.5), (1, 3, 0.9), (2, 9, None)], "query_id int, id int, s double")
    assert sorted((r.query_id, r["rank"], r.id) for r in rerank(hits, F.col("s"), 2).collect()) == [(1, 1, 3), (1, 2, 4), (2, 1, 9)]


def test_structured_context(spark):
    contents = ["Product: Red Shirt\nPrice: 1,390.50 USD\nAvailability: In Stock", "Price: 20", "x" * 500, "", None]
    rows = spark.createDataFrame(list(enumerate(contents)), "i int, c string").select("i", structured_context(F.col("c")).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {0: "Product: Red Shirt\nPrice: 1390.50 USD\nAvailability: In Stock", 1: "Price: 20 BDT\nPrice: 20", 2: "x" * 400, 3: "", 4: ""}


def test_reasoning_kind(spark):
    def plain(text):
        t, n = (text or "").lower(), len(plain_entities(text))
        has = lambda words: any(w in t for w in words)
        return "none" if not n else "comparison" if n >= 2 and has(COMPARE) else "recommendation" if has(RECOMMEND) else "compatibility" if has(MATCH) else "related"

    texts = [*TEXTS, "Compare Nokia, Sony", "Which is like Nokia?", "Nokia pairs with", "compare them"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", reasoning_kind(F.col("t"), entities(F.col("t"))).alias("k")).collect()
    assert all(r.k == plain(texts[r.i]) for r in rows) and len({r.k for r in rows}) == 5


def test_safe_select(spark):
    given = {"SELECT a FROM pages": True, " select 1": True, "SELECT a FROM pages JOIN users ON x": False, "DROP TABLE pages": False, "SELECT 1; delete from pages": False, "SELECT updated FROM Pages": True, "": False, None: False}
    rows = spark.createDataFrame([(x,) for x in given], "s string").select("s", safe_select(F.col("s"), ["pages"]).alias("ok")).collect()
    assert {r.s: r.ok for r in rows} == given


def test_within_budget(spark):
    costs = {"a": 1, "b": 2, "n": 3, "r": 5}
    rows = spark.createDataFrame([(0, ["a", "b", "a", "n", "r", "b"]), (1, []), (2, None), (3, ["r", "x", "r", "n", "a"])], "i int, s array<string>")
    got = {r.i: r.k for r in rows.select("i", within_budget(F.col("s"), costs, 9).alias("k")).collect()}
    assert got == {0: ["a", "b", "a", "n", "b"], 1: [], 2: None, 3: ["r", "x", "a"]}
