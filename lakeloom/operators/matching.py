"""Records of two tables that are one: by address, or by titles that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Titles match above this share of common words.
SIMILAR = 0.85


def title_words(title: Column) -> Column:
    """The distinct words of a title in lower case, sorted; none if it is null."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)))


def _address(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", "")


def _rarest(classes: DataFrame, counts: DataFrame, above: float) -> DataFrame:
    """(words, key): each class under those of its words of which another class that is similar must have one.

    Sets whose Jaccard is above ``above`` share more than that part of either, so
    their rarest words, all but that many, have one in common.
    """
    ranked = classes.select("words", F.explode("words").alias("word")).join(counts, "word").groupBy("words").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked"))
    size = F.size("ranked")
    first = F.slice("ranked", F.lit(1), size - F.ceil(size * above - 1e-9).cast("int") + 1)
    return ranked.select("words", F.explode(F.transform(first, lambda x: x["word"])).alias("key"))


def first_matches(entities: DataFrame, results: DataFrame, above: float = SIMILAR) -> DataFrame:
    """(id, position, by_url) of (id, url, title) and (position, url, title): each entity's first result.

    A result matches if the addresses are equal but for slashes at the end (two
    empty ones are equal), or if both titles have words and their Jaccard is
    above ``above``; of all that match, the one of smallest position counts, and
    ``by_url`` says whether its address is equal.  Positions are unique and not
    null.  An entity without a match has nulls; a null address or title is empty;
    repeated rows are answered alike, and a null id stays null.

    Only the first result of each set of words can win, so both sides are reduced
    to sets of words before they meet, and copies of a title make no pairs.
    """
    own = entities.select("id", _address(F.col("url")).alias("address"), title_words(F.col("title")).alias("words"))
    other = results.select("position", _address(F.col("url")).alias("address"), title_words(F.col("title")).alias("words"))
    by_url = other.groupBy("address").agg(F.min("position").alias("at_url"))

    asked, given = own.where("size(words) > 0").select("words").distinct(), other.where("size(words) > 0").groupBy("words").agg(F.min("position").alias("position"))
    counts = asked.unionByName(given.select("words")).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    right = _rarest(given, counts, above).join(given, "words").select(F.col("words").alias("other"), "key", "position")
    pairs = _rarest(asked, counts, above).join(right, "key").where(F.least(F.size("words"), F.size("other")) > above * F.greatest(F.size("words"), F.size("other")))
    alike = F.size(F.array_intersect("words", "other")) / F.size(F.array_union("words", "other")) > above
    by_title = pairs.where(alike).groupBy("words").agg(F.min("position").alias("at_title"))

    found = own.join(by_url, "address", "left").join(by_title, "words", "left").withColumn("position", F.least("at_url", "at_title"))
    # The address may be equal at a later place as well; the title's result may have it too.
    return found.select("id", "position", F.when(F.col("position").isNotNull(), F.coalesce(F.col("at_url") == F.col("position"), F.lit(False))).alias("by_url"))
