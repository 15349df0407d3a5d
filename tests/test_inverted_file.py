import numpy as np
import pytest

from lakeloom.operators import inverted_file
from lakeloom.operators.inverted_file import build, search


def exact(queries, rows, k):
    out = {}
    for i, q in queries:
        near = []
        for j, x in rows:
            if i != j:
                size = np.linalg.norm(q) * np.linalg.norm(x)
                near.append((-round(float(np.dot(q, x) / size) if size else 0.0, 6) + 0.0, j))
        out[i] = [(j, -s) for s, j in sorted(near)[:k]]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, [float(y) for y in x] if x is not None else None, 1) for i, x in rows], "id long, vector array<double>, list int").repartition(4)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.id, r.similarity + 0.0))
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16)) * 2
    return list(enumerate(np.concatenate([c + rng.normal(size=(50, 16)) * 0.6 for c in centres])))


def test_all_lists_probed_is_exact_and_parts_change_nothing(spark, clustered, monkeypatch):
    queries = clustered[::100]
    index = build(table(spark, clustered), lists=20, rounds=3)
    assert found(search(index, table(spark, queries), 10, 20)) == exact(queries, clustered, 10)
    monkeypatch.setattr(inverted_file, "PART_NUMBERS", 16 * 7)  # seven rows a part
    small = build(table(spark, clustered), lists=20, rounds=3)
    assert max(small.parts.values()) > 5
    assert found(search(small, table(spark, queries), 10, 20)) == exact(queries, clustered, 10)


def test_recall_by_probes(spark, clustered):
    queries = clustered[::50]
    want = exact(queries, clustered, 10)
    index = build(table(spark, clustered), lists=30, rounds=6)
    recall = []
    for probes in (1, 4, 16):
        got = found(search(index, table(spark, queries), 10, probes))
        recall.append(np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in want[q]}) / 10 for q in want]))
    assert recall[0] > 0.5 and recall[1] >= 0.9 and recall[2] > 0.99 and recall == sorted(recall)


def test_edges(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0]), (5, None), (6, []), (7, [float("nan"), 1.0]), (8, [1.0, 2.0, 3.0]), (9, [3.0, 0.0])]
    index = build(table(spark, rows), lists=4, rounds=2)
    usable = [(i, np.array(x)) for i, x in rows if i in (1, 2, 3, 4, 9)]
    got = found(search(index, table(spark, rows), 3, 4))
    # Ties go to smaller ids; vectors of another length than most take no part.
    assert got == exact(usable, usable, 3)
    empty = build(table(spark, []).limit(0), lists=4)
    assert search(empty, table(spark, rows), 3).count() == 0
    assert search(index, table(spark, []).limit(0), 3).count() == 0


def test_bundled_vectors(spark):
    from lakeloom.plans.retrieval import all_lists_top_k, indexed_top_k

    want, got = (found(f(spark, "/root/testdata/sf0.01")) for f in (all_lists_top_k, indexed_top_k))
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall > 0.7
