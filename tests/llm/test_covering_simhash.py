import random
import re

import numpy as np
import pytest
import xxhash

from lakeloom.llm.covering_simhash import Config, covering_masks, forest, linked_pairs, near_duplicates, spans_of


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes):
    """{node: smallest node reachable} of {node: {fingerprints}}."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(n, f) for n, own in nodes.items() for f in own]
    for k, (a, x) in enumerate(flat):
        for b, y in flat[:k]:
            if (x ^ y).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2, 3):
        masks = covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = random.Random(radius)
        for _ in range(20_000):
            bits = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & bits for m in masks)
    assert all(32 <= m.bit_count() <= 36 for m in covering_masks(3))
    spans = spans_of(0xFF00FF00FF00FF00, 3)
    assert sum(spans) == 0xFF00FF00FF00FF00 and all(s.bit_count() == 8 for s in spans)


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 12, 300).astype(np.uint64)
    fps = np.unique(fps)
    want = components({k: {int(f)} for k, f in enumerate(fps)})
    pairs = forest(fps, 3)
    assert len(pairs) == len(fps) - len(set(want.values()))
    assert all(int(fps[a] ^ fps[b]).bit_count() <= 3 for a, b in pairs)


@pytest.mark.parametrize("bucket_rows", [4096, 60])
def test_pairs_of_dense_and_sparse_fingerprints(spark, bucket_rows):
    """Whole buckets, and buckets refined again and again."""
    rng = random.Random(bucket_rows)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {0} | {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(10)} | {base[0] ^ (x << 20) for x in rng.sample(range(1 << 10), 200)}
    nodes = dict(enumerate(sorted(fps)))
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in nodes.items()], "fp long, rep long").repartition(3)
    pairs = linked_pairs(rows, Config(bucket_rows=bucket_rows)).collect()
    assert all((nodes[r.a] ^ nodes[r.b]).bit_count() <= 3 for r in pairs)
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in pairs:
        parent[max(root(r.a), root(r.b))] = min(root(r.a), root(r.b))
    assert {n: root(n) for n in nodes} == components({n: {f} for n, f in nodes.items()})


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"W{k}" for k in range(400)]
    rows = [(-5, "one text"), (-5, "another text for the id"), (-4, "another text for the id"), (None, "one text"), (None, None), (7000, None), (7001, ""), (7002, " \t\n"), (7003, "ONE text"), (7004, "İ ß é x"), (7005, "x " * 300_000)]
    for i in range(25):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 60, 700]))]
        for k in range(rng.randint(1, 9)):
            own = list(words)
            if len(own) > 50:
                own[rng.randrange(len(own))] = "other"
            rows.append((100 * i + k, rng.choice([" ", "\n", " \t"]).join(own)))
    rows += [(9000 + k, "a hot text") for k in range(40)]
    docs = spark.createDataFrame([(i, t, "00", 1) for i, t in rows], "doc_id long, text string, fp string, rep int").repartition(4)
    got = near_duplicates(docs, Config(copies=8))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    nodes: dict = {}
    for i, t in rows:
        if i is not None:
            nodes.setdefault(i, set()).add(fingerprint(t))
    of = components(nodes)
    want = [(i, f"{fingerprint(t):016x}", of.get(i)) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
