import random
import re

import pytest

from lakeloom.llm import common
from lakeloom.llm.components import connected_components
from lakeloom.llm.jaccard_join import Config, jaccard_components


def brute(rows, width, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(parent, 0)
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
                links[i] += 1
                links[j] += 1
    return {i: (len(x), root(i), links[i]) for i, x in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    passage = [rng.choice(vocab) for _ in range(40)]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 8, 30, 120, 400]))] + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append((" " if rng.random() < 0.5 else "\n").join(x.upper() if rng.random() < 0.05 else x for x in w))
    texts += ["", None, "  \t", "Ä b c", "ä b c", "a", "A"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    for config in (Config(sketch_bits=14, group_size=4, queries_per_task=3), Config(width=5, percent=80, sketch_bits=14)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_components(docs, config).collect()}
        assert got == brute(rows, config.width, config.percent)


def test_edges(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, "a b c d"), (9, None)], "doc_id long, text string")
    config = Config(sketch_bits=14)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(docs, config).collect())
    assert got == [(0, 2, None), (5, 2, 5), (5, 2, 5), (7, 2, 5), (9, 0, 9)]
    assert jaccard_components(docs.limit(0), config).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 150)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100, 150: 150, 200: 150}


@pytest.mark.parametrize("proven", [True, False])
def test_components_with_hot_centres(spark, monkeypatch, proven):
    if not proven:  # the other way, for more hot nodes than may be broadcast
        monkeypatch.setattr(common, "bounded", lambda df: df)
    edges = [(500, i) for i in range(60)] + [(600, 1000 + i) for i in range(60)] + [(2000, 3000 + i) for i in range(30)] + [(3005, 1005), (7000, 7001)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), hot=8).collect()}
    want = {**dict.fromkeys([*range(60), 500], 0), 7000: 7000, 7001: 7000}
    want |= dict.fromkeys([600, 2000, *range(1000, 1060), *range(3000, 3030)], 600)
    assert got == want


def test_sketch_levels_are_made_in_pieces():
    """The levels of the whole formula, without arrays of the sketch's size beside the counts and the levels."""
    import tracemalloc

    import numpy as np

    from lakeloom.llm.jaccard_join import sketch_levels

    counts = (np.random.default_rng(3).pareto(0.7, 1 << 20) * 5).clip(0, 4e9).astype(np.uint32)
    tracemalloc.start()
    levels = sketch_levels(counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert levels.nbytes <= peak < 2 * levels.nbytes
    limit = counts.mean() + 6 * np.sqrt(counts.mean()) + 8
    assert np.array_equal(levels, np.where(counts <= limit, 0, 1 + np.floor(np.log2(np.maximum(counts.astype(np.int64), 1) / limit))).astype(np.uint8))
    assert levels.max() > 10 and not sketch_levels(np.zeros(1 << 15, dtype=np.uint32)).any()


def test_what_the_join_writes(spark, monkeypatch):
    """Sets are in no table, prefixes in one; token rows are shuffled once; a set goes to each part of its group once."""
    from lakeloom.llm import jaccard_join

    rng, columns, plans, rows, open_groups = random.Random(5), {}, [], spark.sparkContext.accumulator(0), jaccard_join._open_groups
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in range(20)]
    texts = [" ".join([*base, f"x{i}"]) for base in bases for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def table(df, name, *rest):
        columns[name] = df.columns
        if name == "candidates":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return common.materialise(df, name, *rest)

    def counted(percent):
        run = open_groups(percent)

        def told(batches):
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        return lambda batches: run(told(batches))

    monkeypatch.setattr(jaccard_join, "_open_groups", counted)
    monkeypatch.setattr(jaccard_join, "materialise", table)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_components(docs, Config(sketch_bits=14)).collect()}
    assert got == brute(list(enumerate(texts)), 3, 90)
    assert [name for name, c in columns.items() if "tokens" in c] == []
    assert [name for name, c in columns.items() if "prefix" in c] == ["profiles"]
    assert ["ReusedExchange" in line for line in plans[0].splitlines() if "REPARTITION_BY_COL" in line] == [False, True]
    assert rows.value == len(texts)


def test_texts_may_be_shuffled(spark, monkeypatch):
    """The way for more destinations than may be broadcast."""
    from lakeloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "bounded", lambda df: df)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_components(docs, Config(sketch_bits=14, group_size=4, queries_per_task=3)).collect()}
    assert got == brute(rows, 3, 90)
