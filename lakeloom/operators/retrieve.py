"""What a question retrieves: vector hits, the best product's own chunks, merged locations, keyword hits, one row a title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that ask for a place or for one field, where places are, and the similarities of what is looked up.
PLACE_WORDS = ("store", "location", "shop", "branch", "sylhet", "chittagong", "ctg", "narayanganj", "mirpur", "gulshan", "dhanmondi", "bashundhara", "wari")
ONE_FIELD = r"(?i)\b(how much|price|cost|available|in stock|availability)\b"
PLACES = "store-location"
PINNED, PLACED = 0.95, 0.95
#: Chunks of one source that are looked up at most.
LOOKED_UP = 20
# End of the fixed values.


def asks_for_place(text: Column) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), 0), F.array(*map(F.lit, PLACE_WORDS)))


def short_title(title: Column) -> Column:
    """A title in lower case up to its first dash or bracket."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"\s*[-—(].*$", ""))


def retrieve(questions: DataFrame, near: DataFrame, worded: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, similarity, channel, content) for (query_id, text).

    ``near`` and ``worded`` are the ranked hits (query_id, rank, id, similarity) of
    the vector and the keyword search; ``chunks`` is (id, source, chunk_index,
    title, product, content).  If a question's nearest chunk is a product's, the
    first LOOKED_UP chunks of its source come in front.  A question for a place
    gets the location chunks as one (``content``, elsewhere null) instead of
    single ones.  Keyword hits that are new follow; if there are any keyword hits,
    all are ordered by similarity, ties as they stood, and ``k`` and as many more
    as there are keyword hits stay.  Of a question for one field only the most
    similar chunk of each title stays, at the place of the first.  A question
    without hits has no rows; null sources and titles are empty.
    """
    c = chunks.select("id", F.coalesce("source", F.lit("")).alias("source"), "chunk_index", short_title(F.col("title")).alias("title"), F.coalesce("product", F.lit(False)).alias("product"), "content")
    asked = questions.select("query_id", asks_for_place(F.col("text")).alias("place"), F.coalesce(F.col("text").rlike(ONE_FIELD), F.lit(False)).alias("one_field"))

    of_product = c.where("product AND source <> ''").select("id", "source")
    best = near.where("rank = 1").select("query_id", "id").join(of_product, "id").select("query_id", "source")
    own = Window.partitionBy("source").orderBy("chunk_index", "id")
    shelf = c.join(best.select("source").distinct(), "source", "left_semi").select("source", "id", F.row_number().over(own).alias("at")).where(F.col("at") <= LOOKED_UP)  # hot sources are cut before they are shuffled
    pinned = best.join(shelf, "source").select("query_id", "id", F.lit(PINNED).alias("similarity"), F.lit("pinned").alias("channel"), F.lit(1).alias("step"), "at")

    held = c.where(F.lower("source").contains(PLACES)).orderBy("chunk_index", "id").limit(LOOKED_UP)
    in_order = F.array_sort(F.collect_list(F.struct("chunk_index", "id", "content")))
    merged = held.agg(in_order.alias("x")).where("size(x) > 0").select(F.col("x")[0]["id"].alias("id"), F.array_join(F.transform("x", lambda r: r["content"]), "\n\n").alias("content"))
    placed = asked.where("place").crossJoin(F.broadcast(merged))  # one row
    placed = placed.select("query_id", "id", F.lit(PLACED).alias("similarity"), F.lit("place").alias("channel"), F.lit(0).alias("step"), F.lit(1).alias("at"))

    hits = lambda rows, name, step: rows.select("query_id", "id", "similarity", F.lit(name).alias("channel"), F.lit(step).alias("step"), F.col("rank").alias("at"))
    rows = placed.unionByName(pinned).unionByName(hits(near, "vector", 2)).unionByName(hits(worded, "keyword", 3))
    rows = rows.join(asked, "query_id").join(c.select("id", "source", "title"), "id")
    elsewhere = ~F.contains("source", F.lit(PLACES)) | ~F.col("place") | F.col("step").isin(0, 3) | (F.count_if(F.col("step") == 0).over(Window.partitionBy("query_id")) == 0)
    # A question's rows are few: 20 pinned ones, one place, and its hits.
    first = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("step", "at"))
    rows = rows.withColumn("stays", elsewhere).where("stays").withColumn("place_of_id", first).where("place_of_id = 1")
    many = worded.groupBy("query_id").agg(F.count("*").alias("more"))
    rows = rows.join(many, "query_id", "left")
    by_similarity = F.when(F.col("more") > 0, -F.col("similarity")).otherwise(F.lit(0.0))
    ordered = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(by_similarity, "step", "at"))).where(F.col("more").isNull() | (F.col("n") <= k + F.col("more")))
    key = F.when(F.col("one_field") & (F.col("title") != ""), F.concat(F.lit("t"), "title")).otherwise(F.concat(F.lit("i"), "id"))
    kept = ordered.groupBy("query_id", key.alias("key")).agg(F.min("n").alias("n"), F.min_by(F.struct("id", "similarity", "channel"), F.struct((-F.col("similarity")).alias("s"), "n")).alias("x"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("n"))
    out = kept.select("query_id", rank.alias("rank"), "x.id", "x.similarity", "x.channel")
    return out.join(F.broadcast(merged.withColumnRenamed("id", "merged_id")), (F.col("channel") == "place") & (F.col("id") == F.col("merged_id")), "left").select("query_id", "rank", "id", "similarity", "channel", "content")
