"""Every query that has SQL gives the rows that DuckDB gives for it."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 9)
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def compare(spark, name, sf=SF):
    got = entry.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = sorted((tuple(_plain(r[c]) for c in order) for r in got.collect()), key=repr)
    other = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert len(rows) == len(other), (len(rows), len(other))
    assert rows, "no rows"
    wrong = [(a, b) for a, b in zip(rows, other, strict=True) if a != b]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_query(spark, name):
    compare(spark, name)


def test_others_run(spark):
    for name, f in entry.queries().items():
        if name not in entry.oracle_sql() and not name.startswith(("op", "pipeline")):
            assert f(spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
