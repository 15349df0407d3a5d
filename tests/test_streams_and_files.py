"""Streams give what tables give; files go out and come back."""

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from lakeloom.sources import files
from lakeloom.streaming.state import anchored_counts, meter, run_meters, stream_anchored_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture
def events(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, i, start + dt.timedelta(seconds=s)) for i, s in enumerate((0, 10, 299, 300, 301, 599, 600, 1200))] + [(2, 100 + i, start + dt.timedelta(seconds=100 * i)) for i in range(7)]
    return spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")


WANT = {0: 1, 1: 2, 2: 3, 3: 1, 4: 2, 5: 3, 6: 1, 7: 1, 100: 1, 101: 2, 102: 3, 103: 1, 104: 2, 105: 3, 106: 1}


def test_anchored_windows(events):
    assert {r.event_id: r.in_window for r in anchored_counts(events, 300).collect()} == WANT


def test_anchored_windows_of_nulls_and_ties(spark, events):
    at = dt.datetime(2024, 1, 1)
    rows = [(3, 200, None), (3, 201, at), (3, 202, at), (None, 203, at), (None, 204, None)]
    more = events.unionByName(spark.createDataFrame(rows, events.schema))
    assert {r.event_id: r.in_window for r in anchored_counts(more, 300).collect()} == WANT | {200: None, 201: 1, 202: 2, 203: 1, 204: None}
    assert anchored_counts(more.limit(0), 300).count() == 0


def test_anchored_stream(spark, events, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")

    def run():
        stream = stream_anchored_counts(spark.readStream.schema(events.schema).parquet(src), 300).writeStream.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(out))
        stream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)

    events.where("ts < '2024-01-01 00:05:00'").coalesce(1).write.parquet(src)
    run()
    events.where("ts >= '2024-01-01 00:05:00'").coalesce(1).write.mode("append").parquet(src)
    run()
    assert {r.event_id: r.in_window for r in spark.read.parquet(out).collect()} == WANT


def test_meters(spark, tmp_path):
    table = {(r.tenant, r.period): (r.requests, r.cents) for r in meter(spark.read.parquet(f"{SF}/events.parquet")).collect()}
    assert {(r.tenant, r.period): (r.requests, r.cents) for r in run_meters(spark, SF, f"file://{tmp_path}/m").collect()} == table


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.exe").write_text("no")
    (tmp_path / "map.md").write_text("<urlset><url><loc> http://x/1 </loc></url><loc>http://x/2</loc></urlset>")
    texts = files.read_texts(spark, str(tmp_path))
    assert sorted(r.text for r in texts.collect())[-1] == "héllo" and texts.count() == 2
    assert {r.address for r in files.sitemap_addresses(texts).collect()} == {"http://x/1", "http://x/2"}


def test_archive(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder = f"{tmp_path}/archive"
    files.archive_pages(pages, folder, "2024-01-01")
    back = files.read_archive(spark, folder, "2024-01-01")
    assert back.count() == pages.count() and not files.read_archive(spark, folder, "2024-01-02").count()
    written = list((tmp_path / "archive").rglob("*.json.gz"))
    assert written and gzip.open(written[0]).readline()


def test_rewrites(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 1, "b"), (2, 1, 1, "c")], "k long, t long, i long, v string")
    assert {(r.k, r.v) for r in files.latest_state(rows, "k", "t", "i").collect()} == {(1, "b"), (2, "c")}
    assert files.without(rows, spark.createDataFrame([(1,)], "k long"), "k").count() == 1
    files.append_log(rows, f"{tmp_path}/log")
    files.append_log(rows, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").where(F.col("k") == 1).count() == 4
