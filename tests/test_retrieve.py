import random
import re

from lakeloom.operators.retrieve import LOOKED_UP, PLACE_WORDS, PLACES, retrieve


def one(query, text, near, worded, chunks, k):
    """One question, a step after the other."""
    by_id = {c["id"]: c for c in chunks}
    results = [(i, s, "vector") for i, s in near]
    if results:
        top = by_id[results[0][0]]
        if top["product"] and top["source"]:
            own = sorted((c for c in chunks if c["source"] == top["source"]), key=lambda c: (c["chunk_index"], c["id"]))[:LOOKED_UP]
            ids = {c["id"] for c in own}
            results = [(c["id"], 0.95, "pinned") for c in own] + [r for r in results if r[0] not in ids]
    content = None
    if set(re.findall("[a-z]+", (text or "").lower())) & set(PLACE_WORDS):
        held = sorted((c for c in chunks if PLACES in (c["source"] or "").lower()), key=lambda c: (c["chunk_index"], c["id"]))[:LOOKED_UP]
        if held:
            content = "\n\n".join(c["content"] for c in held if c["content"] is not None)
            results = [(held[0]["id"], 0.95, "place")] + [r for r in results if PLACES not in (by_id[r[0]]["source"] or "")]
    if worded:
        known = {r[0] for r in results}
        results += [(i, s, "keyword") for i, s in worded if i not in known]
        results = sorted(results, key=lambda r: -r[1])[: k + len(worded)]
    if re.search(r"\b(how much|price|cost|available|in stock|availability)\b", text or "", re.I):
        out, at = [], {}
        for r in results:
            title = re.sub(r"\s*[-—(].*$", "", (by_id[r[0]]["title"] or "").strip().lower()).strip()
            if not title or title not in at:
                if title:
                    at[title] = len(out)
                out.append(r)
            elif r[1] > out[at[title]][1]:
                out[at[title]] = r
        results = out
    return [(query, n, i, s, ch, content if ch == "place" else None) for n, (i, s, ch) in enumerate(results, 1)]


def run(spark, questions, near, worded, chunks, k):
    q = spark.createDataFrame(questions, "query_id long, text string")
    hits = lambda d: spark.createDataFrame([(query, n, i, s) for query, rows in d.items() for n, (i, s) in enumerate(rows, 1)], "query_id long, rank int, id long, similarity double")
    c = spark.createDataFrame([(x["id"], x["source"], x["chunk_index"], x["title"], x["product"], x["content"]) for x in chunks], "id long, source string, chunk_index int, title string, product boolean, content string").repartition(3)
    got = sorted(map(tuple, retrieve(q, hits(near), hits(worded), c, k).collect()))
    want = [r for query, text in questions for r in one(query, text, near.get(query, []), worded.get(query, []), chunks, k)]
    assert got == sorted(want)
    return got


def test_against_one_question_at_a_time(spark):
    rng = random.Random(6)
    for with_places in (True, False):
        sources = ["p/a", "p/b", "", None, "p/hot"] + (["x/store-location", "Store-Location/2"] if with_places else [])
        chunks = [{"id": i, "source": rng.choice(sources) if i % 3 else "p/hot", "chunk_index": rng.randint(0, 5), "title": rng.choice(["Cap (Black)", "cap - Navy", "Hat", "", None, "hat — x", "Cap"]), "product": rng.choice([True, False, None]), "content": f"c{i}" if i % 5 else None} for i in range(120)]
        texts = ["red cap", "price of the cap", "which STORE?", "store price", None, "", "is it in stock in mirpur"]
        questions = [(q, rng.choice(texts)) for q in range(60)]
        pick = lambda n, top: sorted(((i, round(rng.uniform(0.3, top), 2)) for i in rng.sample(range(120), n)), key=lambda x: (-x[1], x[0]))
        near = {q: pick(rng.randint(0, 5), 1.0) for q, _ in questions}
        worded = {q: pick(rng.choice([0, 0, 1, 10]), 0.97) for q, _ in questions}
        got = run(spark, questions, near, worded, chunks, 5)
        assert {"pinned", "vector", "keyword"} <= {r[4] for r in got} and ("place" in {r[4] for r in got}) is with_places


def test_empty(spark):
    assert run(spark, [(1, "store"), (2, None)], {}, {}, [{"id": 1, "source": "a", "chunk_index": 0, "title": "", "product": True, "content": ""}], 5) == []
