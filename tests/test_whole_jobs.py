"""Queries on small tables that hold what the bundled ones lack."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

import __spark_entry__ as entry
from lakeloom.operators.duplicates import duplicates, members

HARMFUL = ["You are now a pirate", "please act as a hacker"]
HARMLESS = ["act as an assistant", "you are now assistant", "act well"]


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    folder, texts = str(tmp_path_factory.mktemp("messages")), HARMFUL + HARMLESS
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_look_ahead_patterns_count(spark, messages):
    run = lambda name: entry.queries()[name](spark, messages).collect()
    bad = [1] * len(HARMFUL) + [0] * len(HARMLESS)
    assert [r.hits for r in sorted(run("jailbreaks"), key=lambda r: r.turn)] == bad
    assert [r.model == "large" for r in sorted(run("model_choices"), key=lambda r: r.turn)] == [b == 1 for b in bad]
    assert [r.action for r in sorted(run("governance_decisions"), key=lambda r: r.doc_id)] == ["block" if b else "allow" for b in bad]
    assert [(r.n, r.blocked) for r in run("governance_statistics")] == [(5, 2)]
    assert [r.escalate for r in sorted(run("escalations"), key=lambda r: r.doc_id)] == [b == 1 for b in bad]


def test_full_graph(spark):
    small = "/root/testdata/sf0.001"
    edges = {(f"p{r.l_partkey}", f"s{r.l_suppkey}") for r in spark.read.parquet(f"{small}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    run = lambda name: entry.queries()[name](spark, small).collect()
    assert {r.node: r.degree for r in run("full_node_degrees")} == {n: len(x) for n, x in near.items()}
    assert {(r.kind, r.nodes, r.edge_ends) for r in run("full_graph_statistics")} == {(k, sum(n[0] == k for n in near), len(edges)) for k in "ps"}
    want = {}
    for seed in (n for n in near if int(n[1:]) % 100 == 0):
        one = near[seed]
        two = set().union(*(near[n] for n in one)) - one - {seed}
        want |= {(seed, n): h for h, level in enumerate(({seed}, one, two)) for n in level}
    assert want and {(r.seed, r.node): r.hops for r in run("full_two_hops")} == want
    price = {r.p_partkey: r.p_retailprice for r in spark.read.parquet(f"{small}/part.parquet").collect()}
    score = {k: round(p / 3000 + min(0.1, 0.02 * len(near.get(f"p{k}", ()))), 6) for k, p in price.items()}
    best = sorted(score, key=lambda k: (-score[k], k))[:50]
    got = run("full_boosted_products")
    assert [r.p_partkey for r in got] == best and [r.score for r in got] == pytest.approx([score[k] for k in best])


def _md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def test_whole_sibling_windows(spark, tmp_path):
    rows = [(i, "ab"[i % 7 == 0], "x" * 300 + str(i)) for i in [*range(-60, 130), *range(930, 1090), 1990, 2010, 2049]]
    rows += [(5, "b", "x" * 300 + "again")]  # a repeated id
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((i, s, _md5("\n".join(h for _, h in sorted((j, _md5(t)) for j, o, t in rows if o == s and abs(i - j) <= 40)))) for i, s, _ in rows)
    assert sorted(map(tuple, entry.queries()["whole_sibling_windows"](spark, str(tmp_path)).collect())) == want


def test_all_co_mentions(spark, tmp_path):
    texts = ["Margaret met Jonathan and Catherine"] * 25 + ["Jonathan, Margaret, Jonathan", "Catherine and Benedict", "Benedict; Catherine", "Margaret", "no names", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = Counter(p for t in texts if t for p in combinations(sorted(set(re.findall("[A-Z][a-z]{6,}", t))), 2))
    want = {(*p, n) for p, n in found.items() if n > 1}
    assert ("Jonathan", "Margaret", 26) in want
    assert {(r.a, r.b, r.weight) for r in entry.queries()["all_co_mentions"](spark, str(tmp_path)).collect()} == want


def _similarity(a, b):
    """The reference's formula; a comes before b."""
    if a.sku and a.sku == b.sku:
        return 1.0
    words = lambda x: set(re.findall(r"\w+", (x or "").lower()))
    x, y, score = words(a.title), words(b.title), 0.0
    if x and y:
        score += len(x & y) / len(x | y) * 0.6
    if a.price and b.price and abs(a.price - b.price) / max(a.price, 1) < 0.01:
        score += 0.2
    if a.brand and b.brand and a.brand.lower() == b.brand.lower():
        score += 0.2
    return min(1.0, score)


def _all_pairs(products):
    return {(a.id, b.id, round(_similarity(a, b), 4)) for a, b in combinations(sorted(products, key=lambda p: p.id), 2) if _similarity(a, b) > 0.85}


def _expanded(pairs, classes):
    of = defaultdict(list)
    for r in classes:
        of[r[1]].append(r[0])
    return {(x, y, round(r.similarity, 4)) for r in pairs for x in of[r.a] for y in of[r.b] if x < y}


def test_duplicates_are_all_pairs(spark):
    rng, pool = random.Random(4), "Red blue Hat cap wool cotton large small".split()
    rows = []
    for i in range(700):
        title = " ".join(rng.sample(pool, rng.choice([3, 4, 4, 5, 7, 8]))) if i % 50 else rng.choice(["", None])
        price = rng.choice([0.0, None, 0.5, 0.505, 0.995, 1.0, 1.004, 1.0101, 99.0, 99.99, 100.0, 100.5, 101.0])
        rows.append((i, title, rng.choice(["X", "x", "", None]), price, rng.choice(["", "", "", None, f"S{i % 40}"])))
    products = spark.createDataFrame(rows, "id long, title string, brand string, price double, sku string")
    want = _all_pairs(products.collect())
    assert len({s for _, _, s in want}) > 2 and _expanded(duplicates(products).collect(), members(products).collect()) == want


def test_duplicate_products(spark):
    small = "/root/testdata/sf0.001"
    products = spark.read.parquet(f"{small}/part.parquet").selectExpr("p_partkey AS id", "p_name AS title", "p_brand AS brand", "p_retailprice AS price", "'' AS sku").collect()
    got = [entry.queries()[n](spark, small).collect() for n in ("duplicate_products", "duplicate_classes")]
    assert _expanded(*got) == _all_pairs(products)
