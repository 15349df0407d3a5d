"""Vector and keyword search on small tables, against brute force."""

import random
import re

import numpy as np

from lakeloom.operators.search import bm25, hashed_vectors
from lakeloom.operators.vector import cosine_top_k


def brute_cosine(queries, rows, k):
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1)
    return {(q, i + 1, r, round(s, 6)) for q, x in queries for i, (s, r) in enumerate(sorted(((round(float(unit(x) @ unit(y)), 6), r) for r, y in rows if r != q), key=lambda t: (-t[0], t[1]))[:k])}


def test_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [1.0, 2.0, 0.5]) for i in rng.permutation(100)] + [(1000 + i, rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    got = {tuple(r) for r in cosine_top_k(df.where("id % 50 = 0"), df, 7).collect()}
    assert got == brute_cosine([r for r in rows if r[0] % 50 == 0], rows, 7)


def test_unusable_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (7, [1.0, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    assert {(r.query_id, r.id, r.similarity) for r in cosine_top_k(df, df, 5).collect()} == {(1, 7, 0.707107), (7, 1, 0.707107), (1, 6, 0.0), (6, 1, 0.0), (7, 6, 0.0), (6, 7, 0.0)}
    assert cosine_top_k(df.limit(0), df, 5).count() == 0 and cosine_top_k(df, df.limit(0), 5).count() == 0


def test_bm25_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 40)))) for i in range(200)] + [(900, None), (901, ""), (902, "common " * 5000)]
    asked = [(i, " ".join(rng.choices([*vocab, "common", "absent"], k=rng.randint(1, 3)))) for i in range(12)] + [(50, ""), (51, None)]
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    for every in (False, True):
        want = set()
        for q, text in asked:
            ts = set(re.findall("[a-z0-9]+", text or ""))
            scored = []
            for d, w in words.items():
                if not ts & set(w) or every and not ts <= set(w):
                    continue
                df = {t: sum(t in x for x in words.values()) for t in ts}
                s = sum(np.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in ts if t in w)
                scored.append((-round(float(s), 5), d))
            want |= {(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:4])}
        frames = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        assert {(r.query_id, r["rank"], r.id, r.score) for r in bm25(*frames, 4, every_term=every).collect()} == want


def test_hashed_vectors(spark):
    rows = {r.id: r.vector for r in hashed_vectors(spark.createDataFrame([(1, "a A b"), (2, ""), (3, None)], "doc_id long, text string"), "doc_id", "text").collect()}
    assert sorted(rows[1])[-2:] == [1.0, 2.0] and not any(rows[2]) and not any(rows[3]) and len(rows[1]) == 256
