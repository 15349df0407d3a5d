import random
import re

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.vocabulary import SOURCE_PRIORITY
from lakeloom.operators.variants import SOURCE_CONFIDENCE, confidence_summary, resolved_variants

SCHEMA = "product long, position long, source string, sku string, title string, price string, currency string, available boolean, stock long, options map<string,string>, barcode string, weight double, image_url string"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def fold(rows):
    """The variants of one product, a record at a time, the most trusted first."""

    def number(x):
        try:
            return float(str(x).replace(",", ""))
        except ValueError:
            return 0.0

    rank = lambda source: SOURCE_PRIORITY.get(source, 0)
    out, inventory = {}, {}
    for r in sorted(rows, key=lambda r: (-rank(r["source"]), r["position"])):
        new = {c: (r[c] or "").strip() for c in ("sku", "title", "currency", "barcode", "image_url")} | {"price": number(r["price"]), "weight": r["weight"] or 0.0}
        title = re.sub(r"\s+", " ", new["title"].lower())
        key = f"sku:{new['sku']}" if new["sku"] else f"title:{title}" if title else f"row:{r['position']}"
        conf = SOURCE_CONFIDENCE.get(r["source"], 0.5)
        if new["sku"] and r["source"] == "inventory_api":
            inventory[key] = r
        v = out.get(key)
        if v is None:
            yes = True if r["available"] is None else r["available"]
            v = out[key] = new | {"available": yes, "stock": r["stock"], "options": dict(r["options"] or {}), "sources": {}, "conf": {}, "conflicts": []}
            for f in ("sku", "title", "price", "currency", "available", "options", "barcode"):
                if v[f] not in ("", 0.0, {}, False):
                    v["sources"][f], v["conf"][f] = r["source"], conf
            continue
        for f in ("title", "price", "currency", "barcode", "weight", "image_url"):
            if new[f] in ("", 0.0):
                continue
            if rank(r["source"]) > rank(v["sources"].get(f, "")):
                if v[f] and v[f] != new[f]:
                    v["conflicts"].append((f, str(v[f]), str(new[f]), r["source"]))
            elif v[f]:
                continue
            v[f] = new[f]
            v["sources"][f], v["conf"][f] = r["source"], conf
        if r["available"] is not None and (r["source"] == "inventory_api" or rank(r["source"]) > rank(v["sources"].get("available", ""))):
            v["available"] = r["available"]
            v["sources"]["available"], v["conf"]["available"] = r["source"], conf
        if r["stock"] is not None and r["source"] in ("inventory_api", "xhr_api", "graphql"):
            v["stock"] = r["stock"]
        for k, x in (r["options"] or {}).items():
            v["options"].setdefault(k, x)
    for key, r in inventory.items():
        v = out[key]
        v["available"] = v["available"] if r["available"] is None else r["available"]
        v["stock"] = v["stock"] if r["stock"] is None else r["stock"]
        v["sources"]["available"], v["conf"]["available"] = "inventory_api", 0.98
    return out


def compare(spark, rows):
    got = {}
    for r in resolved_variants(spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA).repartition(3)).collect():
        assert (r.product, r.key) not in got
        got[r.product, r.key] = {c: r[c] for c in ("sku", "title", "price", "currency", "barcode", "weight", "image_url", "available", "stock", "options", "sources")} | {"conf": r.confidence, "conflicts": [(c.field, c.old_value, c.new_value, c.new_source) for c in r.conflicts]}
    want = {(p, k): v for p in {r["product"] for r in rows} for k, v in fold([r for r in rows if r["product"] == p]).items()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == v, (k, got[k], v)
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_a_fold(spark, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    rows = []
    for p in range(60):
        for i in rng.sample(range(100), rng.randint(1, 12)):
            rows.append({"product": p if p else None, "position": i, "source": pick(*SOURCE_CONFIDENCE, "og_meta", "other", None), "sku": pick("", None, "A", "A ", "B"), "title": pick("", "Red  M", "red m", None, "L"), "price": pick(None, "", "0", "1,390.50", "free", "12"), "currency": pick("", "BDT", None), "available": pick(True, False, None), "stock": pick(None, 0, 5), "options": pick(None, {}, {"size": "M"}, {"size": "L", "color": "red"}), "barcode": pick("", "77", None), "weight": pick(None, 0.0, 1.5, 2.0), "image_url": pick("", "i.png", "j.png")})
            if rows[-1]["source"] is None:
                rows[-1]["source"] = ""
    compare(spark, rows)


def row(**given):
    return {"product": 1, "position": 1, "source": "dom", "sku": "A"} | {c: None for c in NAMES[4:]} | given


def test_cases(spark):
    rows = [
        row(position=1, source="shopify_json", price="10", available=True, weight=1.0, options={"size": "M"}),
        row(position=2, source="graphql", price="11", title="Shirt", available=False, weight=2.0, stock=4, options={"size": "L", "color": "red"}),
        row(position=3, source="inventory_api", available=False, stock=0),
    ]
    v = compare(spark, rows)[1, "sku:A"]
    assert (v["price"], v["title"], v["available"], v["stock"], v["options"]) == (10.0, "Shirt", False, 0, {"size": "M", "color": "red"})
    assert v["conflicts"] == [("weight", "1.0", "2.0", "graphql")] and v["sources"]["available"] == "inventory_api"


def test_summary(spark):
    rows = [row(source="llm", title="x", position=1, available=False), row(source="dom", sku="B", position=2, price="5"), row(product=2, source="shopify_json", position=1)]
    df = resolved_variants(spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA))
    # llm: code and title at 0.15; dom: code, price and availability at 0.5; shopify_json: code and availability at 1.
    assert {tuple(r) for r in confidence_summary(df).collect()} == {(1, 0.36, 1, 0), (2, 1.0, 0, 0)}
    assert confidence_summary(df.limit(0)).count() == 0
