import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm.nearest_neighbours import Config, search


def brute(rows, k):
    found = {}
    for q, x in rows:
        if q % 20:
            continue
        scores = sorted(((-float(np.dot(np.float64(x), np.float64(y))), i) for i, y in rows if i != q))[:k]
        found[q] = [(i, -s) for s, i in scores]
    return found


def listed(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("bucket_rows", [20_000, 40])
def test_recall(spark, bucket_rows):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    rows = list(zip(table["vec_id"].to_pylist(), np.array(table["embedding"].to_pylist()), strict=True))
    got = listed(search(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("vec_id") % 20 == 0, config=Config(bucket_rows=bucket_rows)))
    want = brute(rows, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit / (20 * len(want)) >= 0.9
    exact = dict(rows)
    assert all(abs(s - np.float64(exact[q]) @ np.float64(exact[i])) < 1e-12 for q in got for i, s in got[q])
    assert all(v == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values())


def test_edges(spark):
    one, other = [1.0, 0.0, 0.0], [0.5, 0.5, 0.0]
    rows = [(i, one) for i in range(0, 50)] + [(100, other), (120, [0.0, 0.0, 0.0]), (140, None), (160, [1.0, float("nan"), 0.0]), (180, [float("inf"), 0.0, 0.0]), (200, [1.0, None, 0.0]), (220, [1.0]), (100, other), (None, one), (61, [3.0, 0.0, -1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = listed(search(df, F.col("vec_id") % 20 == 0, k=5))
    assert got.keys() == {0, 20, 40, 100}
    assert got[0] == [(61, 3.0), (1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)]
    assert got[20] == [(61, 3.0), (0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)]
    assert got[100] == [(61, 1.5), (0, 0.5), (1, 0.5), (2, 0.5), (3, 0.5)]
    few = listed(search(df.where("vec_id IN (0, 100, 61)"), F.col("vec_id") % 20 == 0, k=5))
    assert few[0] == [(61, 3.0), (100, 0.5)]
    assert search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
