from pyspark.sql import functions as F

from lakeloom.streaming.ingest import actions, current_chunks, ingest_batch, known_state, start_ingest

SCHEMA = "source string, at long, text string"


def state(spark, folder):
    chunks = {(r.source, r.chunk_index, r.chunk) for r in current_chunks(spark, folder).collect()}
    done = {(r.number, r.source, r.action) for r in actions(spark, folder).collect()}
    return chunks, done, {(r.source, r.number) for r in known_state(spark, folder).collect()}


def test_stream_takes_only_what_changed_and_survives_restarts(spark, tmp_path):
    src, folder = f"{tmp_path}/src", f"file://{tmp_path}/out"
    batches = [
        [("a", 1, "one"), ("b", 1, "two"), ("c", 1, None), (None, 1, "lost"), ("d", 1, "old"), ("d", 2, "new"), ("d", 2, "mew")],
        [("a", 2, "one"), ("b", 2, "two!"), ("e", 1, "five"), ("d", 3, "")],
        [("b", 3, "two"), ("f", 1, "long " * 2000)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        start_ingest(spark.readStream.schema(SCHEMA).parquet(src), folder).awaitTermination(100)
    chunks, done, known = state(spark, folder)
    assert done == {
        (0, "a", "new"), (0, "b", "new"), (0, "c", "new"), (0, None, "error"), (0, "d", "new"),
        (1, "a", "unchanged"), (1, "b", "changed"), (1, "e", "new"), (1, "d", "changed"),
        (2, "b", "changed"), (2, "f", "new"),
    }
    assert known == {("a", 0), ("b", 2), ("c", 0), ("d", 1), ("e", 1), ("f", 2)}
    assert {c for c in chunks if c[0] != "f"} == {("a", 0, "one"), ("b", 0, "two"), ("e", 0, "five")}
    assert len([c for c in chunks if c[0] == "f"]) > 5
    assert all(len(r.vector) == 256 for r in current_chunks(spark, folder).select("vector").collect())


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    first = spark.createDataFrame([("a", 1, "one"), ("b", 1, "two")], SCHEMA)
    second = spark.createDataFrame([("a", 2, "one"), ("b", 2, "changed"), ("c", 1, "three")], SCHEMA)
    ingest_batch(first, 0, folder)
    ingest_batch(second, 1, folder)
    before = state(spark, folder)
    for _ in range(2):
        ingest_batch(second, 1, folder)
        assert state(spark, folder) == before
    ingest_batch(second.limit(0), 2, folder)
    assert state(spark, folder) == before


def test_repeated_rows_count_once(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("hot", k % 3, "text") for k in range(300)], SCHEMA).withColumn("hash", F.lit("clash"))
    ingest_batch(rows, 0, folder)
    assert state(spark, folder) == ({("hot", 0, "text")}, {(0, "hot", "new")}, {("hot", 0)})
