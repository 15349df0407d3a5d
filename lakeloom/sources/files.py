"""Reading knowledge files, and writing page archives and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings that may be read, and the largest file.
ENDINGS = ("txt", "md", "csv", "html", "htm")
LARGEST = 50 * 1024 * 1024


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text) of the text files below a folder that are allowed; one row per file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= LARGEST)
    ending = F.lower(F.substring_index("path", ".", -1))
    return found.where(ending.isin(*ENDINGS)).select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("text"))


def archive_pages(pages: DataFrame, folder: str, day: str) -> None:
    """Pages as compressed JSON, in one folder per day and first letter of the address's hash."""
    keyed = pages.withColumn("address_hash", F.md5("url")).withColumns({"day": F.lit(day), "shard": F.substring("address_hash", 1, 1)})
    keyed.write.mode("append").partitionBy("day", "shard").option("compression", "gzip").json(folder)


def read_archive(spark: SparkSession, folder: str, day: str) -> DataFrame:
    """One day's pages; other days' folders are not touched."""
    return spark.read.json(folder).where(F.col("day") == day)


def append_log(rows: DataFrame, folder: str) -> None:
    """Append-only history, audit or metric rows."""
    rows.write.mode("append").parquet(folder)


def sitemap_addresses(files: DataFrame) -> DataFrame:
    """(source, address) of every <loc> in stored sitemaps of (source, text)."""
    found = F.regexp_extract_all("text", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)
    return files.select("source", F.explode(F.array_distinct(found)).alias("address"))


def without(rows: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """A table without the rows that a key table names: deletion by rewriting."""
    return rows.join(doomed.select(key).distinct(), key, "left_anti")


def latest_state(events: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Upserts as a fold: the newest event of each key is its state."""
    columns = [c for c in events.columns if c not in (key, time, tie)]
    newest = F.max(F.struct(time, tie, *columns)).alias("s")
    return events.groupBy(key).agg(newest).select(key, *[F.col(f"s.{c}").alias(c) for c in (time, tie, *columns)])


def nested_sitemap_addresses(files: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(root, address) of the pages that stored sitemaps of (source, text) name, from those named in (root) on.

    An address that ends in ``.xml`` is another sitemap, at most ``depth`` levels
    below its root; one that isn't stored has no pages.  Each page of a root is
    there once, however many sitemaps name it; a sitemap is read once for a root,
    so circles end.  Each level is one join by name.
    """
    known = sitemap_addresses(files).select("source", F.trim("address").alias("address")).where("address <> ''")
    front = roots.select("root", F.col("root").alias("source")).distinct()
    seen, pages = front, None
    for level in range(depth + 1):
        named = front.join(known, "source").select("root", "address").distinct()
        own = named.where(~F.endswith("address", F.lit(".xml")))
        pages = own if pages is None else pages.unionByName(own)
        if level < depth:
            front = named.where(F.endswith("address", F.lit(".xml"))).select("root", F.col("address").alias("source")).join(seen, ["root", "source"], "left_anti")
            seen = seen.unionByName(front)
    return pages.distinct()
