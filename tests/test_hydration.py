import json
import random

import pytest

from lakeloom.operators.hydration import hydration_products, page_product, product_node

PRODUCT = {"title": "Shirt", "price": "1,390.50", "vendor": "Acme", "variants": [{"sku": "A-1", "price": {"amount": "12"}, "option1": "M", "selectedOptions": [{"name": "Color", "value": "Red"}]}]}


def wrap(x, depth, in_lists=False):
    for k in range(depth):
        x = [x] if in_lists and k % 2 else {"a": x}
    return x


@pytest.mark.parametrize(("depth", "found"), [(0, True), (7, True), (8, True), (9, False)])
def test_depth(depth, found):
    for in_lists in (False, True):
        html = f"<script>window.__STATE__ = {json.dumps(wrap({'x': 1, 'y': wrap(PRODUCT, depth - 1, in_lists)} if depth else PRODUCT, 0))} ;</script>"
        assert (page_product(html).get("title") == "Shirt") is found


def test_only_five_items_of_a_list():
    assert product_node([0, 0, 0, 0, PRODUCT]) == PRODUCT
    assert product_node([0, 0, 0, 0, 0, PRODUCT]) is None


@pytest.mark.parametrize(
    ("kind", "html"),
    [
        ("nextjs", "<script id='__NEXT_DATA__'> %s </script>" % json.dumps({"props": {"pageProps": {"productData": PRODUCT}}})),
        ("nextjs", '<script id="__NEXT_DATA__" type="application/json">%s</script>' % json.dumps({"props": {"pageProps": {"product": "none", "dehydratedState": {"queries": [{"state": {"data": {"q": [PRODUCT]}}}]}}}})),
        ("nuxt", "window.__NUXT__={};".replace("{}", json.dumps({"payload": {"p": PRODUCT}}))),
        ("shopify_analytics", "window.ShopifyAnalytics = %s;" % json.dumps({"meta": {"product": PRODUCT}})),
        ("shopify_theme", "window.product = %s\n;" % json.dumps({"data": {"product": PRODUCT}})),
        ("generic_state", "window.__REDUX_STATE__ = %s;" % json.dumps({"s": PRODUCT})),
        ("redux_state", "window.__PRELOADED_STATE__ = %s;" % json.dumps({"s": PRODUCT})),
        ("embedded_json", '<SCRIPT class=x TYPE="application/json">%s</script>' % json.dumps({"a": 1, "s": PRODUCT})),
    ],
)
def test_every_kind_of_state(kind, html):
    got = page_product(f"<html><p>x</p>{html}</html>")
    assert (got["state"], got["title"], got["brand"], got["price"], got["richness"]) == (kind, "Shirt", "Acme", 1390.5, 6)
    assert got["variants"][0]["options"] == {"option1": "M", "Color": "Red"} and got["variants"][0]["price"] == 12


def test_richest_state_wins_and_ties_go_to_the_first():
    plain = {"title": "Plain", "price": 1}
    html = "window.__NUXT__ = %s; window.product = %s;" % (json.dumps({"payload": plain}), json.dumps({"product": PRODUCT}))
    assert page_product(html)["title"] == "Shirt"
    html = "window.__NUXT__ = %s; window.product = %s;" % (json.dumps({"payload": plain}), json.dumps({"product": plain | {"title": "Other"}}))
    assert page_product(html)["title"] == "Plain"


def test_broken_and_odd_states():
    for html in (None, "", "window.product = {\"product\": {\"title\": \"x\";", "window.product = [1];", '<script id="__NEXT_DATA__">[1]</script>', '<script id="__NEXT_DATA__">{"props": {"pageProps": {"data": [1]}}}</script>', 'window.product = {"product": "x"};', 'window.product = {"product": {"title": "only"}};'):
        assert page_product(html) == {"richness": 0}
    # A semicolon in a string doesn't end the state.
    assert page_product('window.product = {"product": {"title": "a};b", "price": "free", "sku": 7}};')["title"] == "a};b"
    got = page_product('window.product = {"product": {"name": "n", "price": "free", "sku": 7, "available": true, "tags": ["a", 1], "variants": [3, {"price": "x"}]}};')
    assert (got["sku"], got.get("price"), got["availability"], got["tags"], got["variants"][0]["price"]) == ("7", None, "In Stock", "a, 1", None)


def brute_product(node):
    """All nodes with their paths, in depth-first order; the first product at most eight levels down."""
    stack, out = [(node, 0)], None
    while stack:
        x, depth = stack.pop()
        if depth > 8 or not x:
            continue
        if isinstance(x, dict):
            if (x.get("title") or x.get("name")) and any(x.get(k) for k in ("price", "variants", "sku", "priceRange", "handle")):
                return x
            stack += [(v, depth + 1) for v in reversed(list(x.values()))]
        elif isinstance(x, list):
            stack += [(v, depth + 1) for v in reversed(x[:5])]
    return out


def test_search_against_another_walk():
    rng = random.Random(4)

    def tree(depth):
        kind = rng.random()
        if depth > 10 or kind < 0.1:
            return rng.choice([None, 0, "x", {}, [], {"title": "t"}, {"name": "n", "sku": rng.randint(0, 1)}])
        return [tree(depth + 1) for _ in range(rng.randint(0, 6))] if kind < 0.3 else {f"k{i}": tree(depth + 1) for i in range(rng.randint(0, 2))}

    for _ in range(300):
        x = tree(0)
        assert product_node(x) == brute_product(x)


def test_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (2, "window.product = %s;" % json.dumps({"product": PRODUCT}), 5), (None, "x" * 1_000_000, 5)]
    got = hydration_products(spark.createDataFrame(rows, "page_id long, html string, title int"))
    found = sorted(map(tuple, got.select("page_id", "state", "richness", "title").collect()), key=repr)
    assert found == sorted([(1, None, 0, None), (2, None, 0, None), (2, "shopify_theme", 6, "Shirt"), (None, None, 0, None)], key=repr)
    assert hydration_products(spark.createDataFrame([], "page_id long, html string")).count() == 0
