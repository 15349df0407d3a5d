import json

from lakeloom.sources.gold import field_criticality, gold_queries

QUERIES = [
    {"query_id": "q1", "category": "price", "query": "how much", "expected_urls": ["http://s/a//", "http://s/b"], "expected_prices": {"http://s/a": 5}, "expected_fields": {"brand": ["x"]}, "min_completeness": 0.5, "platform_tags": ["shop"]},
    {"query_id": "q2", "category": "lookup", "query": "find", "unknown": 1},
    {"query_id": "q3", "category": "price"},
]


def ids(df):
    return sorted(r.query_id for r in df.collect())


def test_filters(spark, tmp_path):
    path = tmp_path / "gold.json"
    path.write_text(json.dumps({"queries": QUERIES, "platform_coverage": {"shop": ["q1", "q2"]}, "field_criticality": {"title": "critical", "tags": "low"}}, indent=1))
    run = lambda **given: ids(gold_queries(spark, str(path), **given))
    assert run() == ["q1", "q2", "q3"] and run(category="price") == ["q1", "q3"]
    assert run(platform="shop") == ["q1", "q2"] and run(platform="shop", category="price") == ["q1"] and run(platform="other") == []
    q1, q2, _ = sorted(gold_queries(spark, str(path)).collect(), key=lambda r: r.query_id)
    assert q1.expected_urls == ["http://s/a", "http://s/b"] and q1.expected_prices == {"http://s/a": 5.0} and q1.expected_fields == {"brand": ["x"]} and q1.min_completeness == 0.5
    assert (q2.expected_urls, q2.expected_skus, q2.expected_prices, q2.notes, q2.min_completeness) == ([], [], {}, "", None)
    assert {tuple(r) for r in field_criticality(spark, str(path)).collect()} == {("title", "critical"), ("tags", "low")}


def test_flat_list_and_no_coverage(spark, tmp_path):
    flat, bare = tmp_path / "flat.json", tmp_path / "bare.json"
    flat.write_text(json.dumps(QUERIES))
    bare.write_text(json.dumps({"queries": QUERIES}))
    for path in (flat, bare):
        assert ids(gold_queries(spark, str(path), platform="shop")) == ["q1", "q2", "q3"]
        assert ids(gold_queries(spark, str(path), category="lookup")) == ["q2"]
        assert field_criticality(spark, str(path)).count() == 0
