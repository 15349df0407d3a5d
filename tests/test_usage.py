"""Usage reports on sums that doubles do not hold exactly."""

import math

import duckdb

import __spark_entry__ as entry
from lakeloom.operators.aggregate import exact_sum

EVENTS = "event_id long, user_id long, value double"
#: Added in order they make 85, in two halves 84.99999999999999, which is 4.2 and not 4.3 % of 2000.
HALVES = (1.37, 12.15), (52.44, 19.04)


def test_quota_whatever_the_files(spark, tmp_path):
    spark.createDataFrame([(2, "BUILDING")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    for half in HALVES:  # a file each, so that two tasks add up
        spark.createDataFrame([(0, 1, x) for x in half] + [(0, 2, 40 * x) for x in half], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r for r in entry.queries()["quota_status"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT 2 AS c_custkey, 'BUILDING' AS c_mktsegment; CREATE TABLE events (event_id BIGINT, user_id BIGINT, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (0, ?, ?)", [(u, x * (40 if u == 2 else 1)) for u in (1, 2) for half in HALVES for x in half])
    want = {r[0]: r for r in con.execute(entry.oracle_sql()["quota_status"]).fetchall()}
    assert {u: tuple(r) for u, r in got.items()} == want and got[1].percent == 4.3


def test_sums_of_odd_values(spark):
    rows = {"tenths": [0.1] * 10, "none": [None, None], "some": [None, 2.5], "endless": [1.0, math.inf], "large": [1e20, 1.0], "sum too large": [9e17] * 2000, "small": [1e-18, 2e-18], "negative": [-0.1, -0.2]}
    df = spark.createDataFrame([(k, x) for k, xs in rows.items() for x in xs], "k string, x double").repartition(3)
    got = {r.k: r.s for r in df.groupBy("k").agg(exact_sum("x").alias("s")).collect()}
    assert math.isclose(got.pop("sum too large"), 1.8e21, rel_tol=1e-12)
    assert got == {"tenths": 1.0, "none": None, "some": 2.5, "endless": math.inf, "large": 1e20 + 1.0, "small": 3e-18, "negative": -0.3}
    odd = spark.createDataFrame([(math.nan,), (1.0,)], "x double")
    assert math.isnan(odd.agg(exact_sum("x").alias("s")).first().s)
    assert odd.limit(0).agg(exact_sum("x").alias("s")).first().s is None
