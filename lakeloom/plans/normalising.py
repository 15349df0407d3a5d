"""Questions made plain: mixed scripts, shorthand and phrases."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import mixed_words as M
from lakeloom.functions.normalise import DIGITS, REPLACED, SOUNDED, plain_english, widened
from lakeloom.plans.registry import query, table
from lakeloom.plans.texts import s

#: What messages get added, by their number: every phrase, some with letters and digits besides.
ADDED = [a + x for k, (a, _) in enumerate(REPLACED) for x in ("", DIGITS[k % 10])] + ["ব্রিপ", "প্রাইসটা", "কক্ষড়", "daam koto?", "Ferot, policy!", "er"]
SHORT = [*M.SHORTHAND, *M.PHRASES, "Qty:", "XL?", "out of stock!!"]


def mixed_messages(spark: SparkSession, sf_dir: str, added: list[str]) -> DataFrame:
    """(conv_id, turn, text) of all messages, each with one of ``added`` before and after, as the bundled ones have no such words."""
    at = F.pmod(F.col("conv_id") * 31 + F.col("turn") * 7, F.lit(len(added))).cast("int")
    words = F.array(*map(F.lit, added))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", words[at], "text", words[(at + 1) % len(added)]).alias("text"))


def mixed_sql(added: list[str]) -> str:
    words, n = "[" + ", ".join(map(s, added)) + "]", len(added)
    word = lambda more: f"{words}[(conv_id * 31 + turn * 7 + {more}) % {n} + 1]"
    return f"m AS (SELECT conv_id, turn, {word(0)} || ' ' || text || ' ' || {word(1)} AS text FROM conversations)"


def replaced_sql(x: str, pairs: Iterable[tuple[str, str]]) -> str:
    for a, b in pairs:
        x = f"replace({x}, {s(a)}, {s(b)})"
    return x


def words_sql(x: str, words: dict[str, str], other: str) -> str:
    known = "map([" + ", ".join(map(s, words)) + "], [" + ", ".join(map(s, words.values())) + "])"
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '\\s+'), lambda w: coalesce({known}[regexp_replace(lower(w), '{other}', '', 'g')], w)), lambda w: w <> ''), ' ')"


def stripped_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_LATIN = lambda x: words_sql(x, M.LATIN_INTENT_WORDS, "[^a-zA-Z0-9]")
_DIGITS = f"translate({stripped_sql('text')}, '{DIGITS}', '0123456789')"
PLAIN_SQL = f"""WITH {mixed_sql(ADDED)}, a AS (SELECT conv_id, turn, text, {stripped_sql("text")} AS own, {replaced_sql(_DIGITS, REPLACED)} AS x FROM m), b AS (SELECT *, {_LATIN("x")} AS y FROM a), c AS (SELECT *, {replaced_sql("y", SOUNDED)} AS z FROM b),
d AS (SELECT *, CASE WHEN own = '' THEN text WHEN regexp_matches(own, '[\\x{{0980}}-\\x{{09FF}}]') THEN {stripped_sql(f"regexp_replace({words_sql('z', M.SOUND_FIXES, '[^a-z]')}, '[?!.]+$', '')")} ELSE {_LATIN("own")} END AS plain FROM c)"""
_BARE = stripped_sql(f"regexp_replace(lower({stripped_sql('text')}), '[?!.]+$', '')")


@query(f"{PLAIN_SQL} SELECT conv_id, turn, CAST(length(plain) AS INTEGER) AS chars, md5(plain) AS digest, left(plain, 24) AS start FROM d")
def plain_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages, with Bengali words around them, in English."""
    found = mixed_messages(spark, sf_dir, ADDED).withColumn("plain", plain_english(F.col("text")))
    return found.select("conv_id", "turn", F.length("plain").alias("chars"), F.md5("plain").alias("digest"), F.left("plain", F.lit(24)).alias("start"))


@query(f"WITH {mixed_sql(SHORT)}, d AS (SELECT conv_id, turn, {words_sql(replaced_sql(_BARE, M.PHRASES.items()), M.SHORTHAND, '[^a-z0-9]')} AS wide FROM m) SELECT conv_id, turn, CAST(length(wide) AS INTEGER) AS chars, md5(wide) AS digest, left(wide, 24) AS start FROM d")
def widened_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages, with shorthand around them, spelt out."""
    found = mixed_messages(spark, sf_dir, SHORT).withColumn("wide", widened(F.col("text")))
    return found.select("conv_id", "turn", F.length("wide").alias("chars"), F.md5("wide").alias("digest"), F.left("wide", F.lit(24)).alias("start"))
