"""Chunks sized by kind, by worked examples and by what every chunking must hold."""

import random

from lakeloom.operators.chunking import CHUNK_SIZE, OVERLAP, is_atomic, kind_of, semantic_chunk, typed_chunk, typed_chunks


def test_kinds():
    assert [kind_of(x) for x in ("intro\nQ: why?", "a|b", "Price: 3", "# Head", "plain", "Q: one\nPrice: 3")] == ["faq", "table", "product_spec", "documentation", "text", "faq"]


def test_places_stay_whole():
    page = "Shop no 1, first floor\n" * 300
    assert is_atomic(page) and semantic_chunk(page) == [page.strip()]
    assert not is_atomic("Opening hours: nine to five. Second floor.")


def test_long_chunks_are_cut_by_kind():
    text = "Price: 10. " + "A fine and sturdy thing. " * 70  # under the general size, over that of product records
    found = typed_chunk(text)
    assert len(found) > 1 and {k for k, _, _ in found} == {"product_spec"} and {p for _, p, _ in found} == {0}
    assert all(len(c) <= CHUNK_SIZE["product_spec"] for _, _, c in found)


def test_every_word_is_kept():
    rng = random.Random(3)
    for _ in range(30):
        words = [f"w{i}" for i in range(rng.randint(0, 2500))]
        text = "".join(w + rng.choice([" ", " ", ". ", "\n", "\n# H\n", "|"]) for w in words)
        chunks = typed_chunk(text)
        found = " ".join(c for _, _, c in chunks)
        assert all(w in found for w in words[:: max(1, len(words) // 50)])
        parents = [p for _, p, _ in chunks]
        assert parents == sorted(parents) and all(len(c) <= max(CHUNK_SIZE.values()) + OVERLAP for _, _, c in chunks)


def test_as_a_table(spark):
    docs = spark.createDataFrame([(1, "Price: 1. " + "word word. " * 300, "x"), (2, None, "x"), (3, "", "x"), (None, "tiny", "x")], "doc_id long, text string, chunk string")
    rows = typed_chunks(docs).collect()
    assert {r.doc_id for r in rows} == {1, None}
    mine = sorted((r.chunk_index, r.total_chunks) for r in rows if r.doc_id == 1)
    assert mine == [(i, len(mine)) for i in range(len(mine))]
