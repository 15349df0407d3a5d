import random
import re

from lakeloom.operators.product_graph import edges, nodes
from lakeloom.operators.sharing import sharing_counts

COLUMNS = "chunk_id long, title string, brand string, product_type string, chunk_type string, url string, content string"


def brute(rows):
    """The graph, one chunk after the other."""
    ident = lambda label, kind: f"{kind}:" + re.sub("[^a-z0-9]", "_", label.lower().strip())
    found, joined, seen = {}, set(), set()

    def join(a, b, relation, weight, pair):
        if pair not in seen:
            seen.add(pair)
            joined.add((a, b, relation, weight))

    for _, *values in sorted(rows):
        title, brand, category, kind, url, content = (x or "" for x in values)
        if title:
            product = ident(title, "product")
            found[product] = ("product", title, url)
            if brand:
                found[ident(brand, "brand")] = ("brand", brand, None)
                join(product, ident(brand, "brand"), "made_by", 0.9, (product, brand and ident(brand, "brand")))
            if category not in ("", "product", "page"):
                found[ident(category, "category")] = ("category", category, None)
                join(product, ident(category, "category"), "belongs_to", 0.8, (product, ident(category, "category")))
            names = [m for m in re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4}\b", content) if len(m) > 5][:5]
            for name in names:
                if name.lower() != title.lower():
                    other = ident(name, "product")
                    found[other] = ("product", name, None)
                    join(product, other, "mentioned_with", 0.4, tuple(sorted((product, other))))
        if kind == "faq" and content:
            found[ident(content[:40], "faq")] = ("faq", content[:60], None)
        elif kind in ("documentation", "text"):
            policy = next((p for p in ("return policy", "shipping policy", "warranty policy", "refund policy") if p in content.lower()), None)
            if policy:
                found[ident(policy, "policy")] = ("policy", policy.title(), None)
    return {(k, *v) for k, v in found.items()}, joined


def test_against_one_chunk_after_the_other(spark):
    rng = random.Random(8)
    names = ["Red Cap", "Blue Cap", "Green Wool Hat", "Old  Shoe", "Éa Ab Cd", "Ab Cdé", "A B", "Ab C", "X"]
    rows = []
    for i in range(120):
        content = rng.choice(["", "see ", "Return Policy: ", "warranty policy and refund policy ", None])
        content = None if content is None else content + rng.choice([", ", " and ", " "]).join(rng.choice(names) for _ in range(rng.randint(0, 9)))
        rows.append((i, rng.choice(["", None, "Red Cap", "red cap!", "Blue Cap", "Hat"]), rng.choice(["", None, "Acme", "acme "]), rng.choice(["", None, "page", "product", "caps"]), rng.choice(["faq", "text", "documentation", "table", None]), f"u{i}", content))
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    want_nodes, want_edges = brute(rows)
    assert set(map(tuple, nodes(df).collect())) == want_nodes
    assert set(map(tuple, edges(df).collect())) == want_edges
    assert nodes(df).count() == len(want_nodes) and edges(df).count() == len(want_edges)
    assert nodes(df.limit(0)).count() == edges(df.limit(0)).count() == 0


def test_sharing_counts(spark, monkeypatch):
    from lakeloom.operators import sharing

    monkeypatch.setattr(sharing, "BLOCK", 2)  # several blocks
    asked = spark.createDataFrame([(1, "A cat"), (2, "dogs, cat"), (3, None), (None, "cat"), (4, "zebra"), (5, "a"), (5, "the")], "id long, text string")
    docs = spark.createDataFrame([("a b", 1), ("CAT and dogs", 1), (None, 1), ("", 1), ("cat", 1), ("the the", 1)], "text string, id int").repartition(3)
    assert dict(map(tuple, sharing_counts(asked, docs).collect())) == {1: 3, 2: 2, 5: 2}
    assert sharing_counts(asked.limit(0), docs).count() == 0
