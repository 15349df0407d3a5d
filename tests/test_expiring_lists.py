import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.streaming.lists import expiring_lists, run_lists

START = dt.datetime(2024, 1, 1)
SCHEMA = "key long, at long, ts timestamp, item string"


def brute(rows, limit, seconds, as_of=None):
    lists, last = {}, {}
    for key, at, ts, item in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[1], r[3] or "")):
        if key in last and (ts - last[key]).total_seconds() >= seconds:
            lists[key] = []
        lists[key] = [*lists.get(key, []), item or ""][-limit:]
        last[key] = ts
    return {k: v for k, v in lists.items() if as_of is None or last[k] + dt.timedelta(seconds=seconds) > as_of}


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_table_against_brute_force(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.choice([1, 2, 3, 4]), i, at(rng.randint(0, 3000)), f"e{i}") for i in range(150)] + [(None, 1, at(1), "x"), (5, 1, None, "x"), (6, 1, at(1), None), (7, 1, at(5), "same"), (7, 1, at(5), "same")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r.key: r["items"] for r in expiring_lists(df, limit, 60).collect()} == brute(rows, limit, 60)
    assert {r.key: r["items"] for r in expiring_lists(df, limit, 60, F.lit(at(2950))).collect()} == brute(rows, limit, 60, at(2950))
    assert expiring_lists(df.limit(0), limit, 60).count() == 0


def test_stream_expires_refreshes_and_trims(spark, tmp_path):
    """Three batches, each a restart from the checkpoint; after each, the lists are those of the table so far."""
    batches = [
        [(1, 1, at(0), "a"), (1, 2, at(10), "b"), (2, 3, at(0), "x"), (3, 4, at(20), "p")],
        [(1, 5, at(65), "c"), (1, 6, at(70), "d"), (3, 7, at(90), "q")],  # 1 is refreshed and trimmed, 3 starts anew, 2 expires
        [(2, 8, at(200), "y"), (4, 9, at(205), "z")],  # 1 and 3 expire, 2 comes back
        [(4, 10, at(206), "w")],
    ]
    src, seen = f"{tmp_path}/src", []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        got = run_lists(spark.readStream.schema(SCHEMA).parquet(src), 3, 60, f"file://{tmp_path}/out")
        seen += rows
        want = brute(seen, 3, 60, max(r[2] for r in seen))
        assert {r.key: r["items"] for r in got.collect() if r["items"]} == want
    assert want == {2: ["y"], 4: ["z", "w"]}
    assert {r.key for r in got.collect() if not r["items"]} == {1, 3}
