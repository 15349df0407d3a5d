import datetime as dt
import json

import pytest

from lakeloom.sources.cursor_pages import CursorPages
from lakeloom.streaming.frontier import frontier_batch, given, start_frontier

START = dt.datetime(2024, 1, 1)


def test_no_address_is_given_twice(spark, tmp_path):
    """Batches with a restart between them; addresses come again in other forms, later than the state reaches, and wait."""
    src, folder = f"{tmp_path}/src", f"file://{tmp_path}/out"
    batches = [
        [("http://S/b/?utm_source=x", 0), ("http://s/b#top", 1), ("http://s/product/1", 2), ("http://s/c", 3), ("http://s/d", 4), (None, 5)],
        [("HTTP://s/product/1/", 10), ("http://s/a", 11), ("http://s/product/2", 12)],
        [("http://s/b", 86400 * 30), ("http://s/e", 86400 * 30)],
        [("http://s/c", 86400 * 60), ("http://s/f", 86400 * 60), ("http://s/g", 86400 * 60)],
    ]
    told = []
    for rows in batches:
        spark.createDataFrame([(u, START + dt.timedelta(seconds=s)) for u, s in rows], "url string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
        start_frontier(spark.readStream.schema("url string, ts timestamp").parquet(src), folder, size=2).awaitTermination(100)
        out = [r.canonical for r in sorted(given(spark, folder).collect(), key=lambda r: (r.number, r.place))]
        told.append(out[sum(map(len, told)) :])
    flat = [a for part in told for a in part]
    assert len(flat) == len(set(flat))
    assert told[0][:2] == ["http://s/product/1", "http://s/b"] and told[1][0] == "http://s/product/2"  # a batch without rows gives out what waits
    assert set(flat) <= {f"http://s/{x}" for x in ("product/1", "product/2", *"abcdefg")}


def test_a_batch_that_runs_again_gives_the_same(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = lambda *names: spark.createDataFrame([(n, 5) for n in names], "canonical string, priority int")
    frontier_batch(rows("c", "a", "b", "b"), 0, folder, 2)
    for _ in range(2):
        frontier_batch(rows("a", "d", "b0"), 1, folder, 2)  # a has been seen
        assert sorted((r.number, r.place, r.canonical) for r in given(spark, folder).collect()) == [(0, 1, "a"), (0, 2, "b"), (1, 1, "b0"), (1, 2, "c")]
    frontier_batch(rows("x").limit(0), 2, folder, 2)
    frontier_batch(rows("x").limit(0), 3, folder, 2)
    assert [(r.number, r.canonical) for r in given(spark, folder).where("number > 1").collect()] == [(2, "d")]


def put(folder, cursor, items, following, raw=None):
    (folder / f"{cursor}.json").write_text(raw if raw is not None else json.dumps({"items": items, "next": following}))


def run(spark, pages, out, **options):
    spark.dataSource.register(CursorPages)
    stream = spark.readStream.format("cursor_pages").option("path", str(pages))
    for k, v in options.items():
        stream = stream.option(k, v)
    query = stream.load().writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted(map(tuple, spark.read.schema("cursor string, place int, item string").parquet(f"{out}/rows").collect()))


def test_stream_resumes_at_its_cursor(spark, tmp_path):
    pages, out = tmp_path / "pages", tmp_path / "out"
    pages.mkdir()
    put(pages, "first", [{"a": 1}, "two"], "c2")
    put(pages, "c2", [], "c3")
    put(pages, "c3", ["x"], None)
    want = [("c3", 0, "x"), ("first", 0, '{"a": 1}'), ("first", 1, "two")]
    assert run(spark, pages, out, per_batch=2) == want
    assert run(spark, pages, out, per_batch=2) == want  # nothing new
    (pages / "first.json").unlink()  # what was read is not asked for again
    put(pages, "c3", ["x"], "c4")
    put(pages, "c4", ["y", "z"], "c5")  # c5 comes later
    want += [("c4", 0, "y"), ("c4", 1, "z")]
    assert run(spark, pages, out, per_batch=2) == sorted(want)
    put(pages, "c5", ["last"], None)
    assert run(spark, pages, out, per_batch=2) == sorted([*want, ("c5", 0, "last")])


def test_broken_pages(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    put(pages, "first", ["a"], "bad")
    put(pages, "bad", None, None, json.dumps({"items": "none", "next": "c3"}))
    put(pages, "c3", ["b"], None)
    with pytest.raises(Exception, match="can't be read"):
        run(spark, pages, tmp_path / "fails")
    assert run(spark, pages, tmp_path / "skips", broken="skip") == [("c3", 0, "b"), ("first", 0, "a")]
    put(pages, "c3", ["b"], "first")
    with pytest.raises(Exception, match="comes back"):
        run(spark, pages, tmp_path / "circle", broken="skip")
