"""Quality rules with host verdicts, in DataFrame functions alone.

Every document gets counts of its words, symbols and repetitions, and fails
the base rules (too short, too much repeated within 5-word windows), or one of
the soft rules (symbols for words, mostly repeated lines).  Failures are
counted by host (the domain a document comes from), and each host's failure
rate is shrunk towards the rate of all hosts by a beta prior whose two
parameters are estimated from the hosts' own rates by moments.  A host whose
shrunk rate is too high is rejected as a whole; on a host that is merely
doubtful a soft failure is enough.

Counts are made per row, so texts are never shuffled; hosts are aggregated
with partial sums, and the verdicts come back by a join of the small per-
document table, broadcast only where a count shows few hosts.

Defined results: a null or empty text has no words and fails the base rules; a
null host is a host of its own; repeated rows are judged and counted each; an
empty table gives no rows; other columns are not read.  A symbol-ridden
document fails whatever its host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import bounded, materialise

#: What separates words, what is a word, which characters are symbols.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """Thresholds; percentages compare integers, so that no rounding decides."""

    min_words: int = 10
    repeat_percent: int = 20
    symbol_percent: int = 50
    dup_line_percent: int = 50
    reject_rate: float = 0.6
    doubt_rate: float = 0.4


def _repeated_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more in the text.

    Most texts repeat no window, which counting distinct window hashes tells
    at once.  Only for the others are the windows sorted with their places:
    a repeated window at place p covers min(5, next repeated place - p) words.
    """
    windows = F.when(
        F.size(words) >= 5,
        F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - 4), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(5)])))[0],
    ).otherwise(F.array().cast("array<bigint>"))

    def places(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.transform(F.array(ordered), lambda s: F.array_sort(F.transform(again(s), lambda x: x["i"])))[0]

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)

    count = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(F.transform(F.array(places(w)), covered)[0])
    return F.transform(F.array(windows), count)[0]


def document_counts(docs: DataFrame, host: str = "source", *carried: str) -> DataFrame:
    """(doc_id, host, counts, and carried columns): every row's counts, from its whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    one = lambda name, x: F.transform(F.array(x), lambda v: F.struct(F.size(v).cast("long").alias("n"), name(v)))[0]
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        one(lambda v: (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("dup"), lines).alias("lines"),
        one(lambda v: _repeated_words(v).alias("repeated"), words).alias("words"),
        *carried,
    )
    return counted.select(*carried, "doc_id", "host", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), F.col("words.repeated").alias("n_repeat_words"), F.col("lines.n").alias("n_lines"))


def apply_rules(counts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Add base_failed, symbol_failed and failed (any rule)."""
    c = F.col
    base = (c("n_words") < rules.min_words) | (100 * c("n_repeat_words") > rules.repeat_percent * c("n_words"))
    symbols = 100 * c("n_symbols") > rules.symbol_percent * c("n_words")
    lines = 100 * c("n_dup_lines") > rules.dup_line_percent * c("n_lines")
    return counts.withColumns({"base_failed": base, "symbol_failed": symbols, "failed": base | symbols | lines})


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate): failure rates shrunk by an empirical beta prior.

    With m and v the mean and variance of the hosts' rates, the prior has
    strength m(1-m)/v - 1 (at least 1; no spread: as strong as the mean host)
    and mean m; its counts are added to each host's.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(raw).alias("m"), F.var_pop(raw).alias("v"), F.avg("n_docs").alias("size"))
    strength = F.when(F.col("v") > 1e-12, F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)).otherwise(F.col("size"))
    shrunk = (F.col("n_failed") + strength * F.col("m")) / (F.col("n_docs") + strength)
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("rate"))  # the prior is one row


def judge(docs: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """Every document's counts, base_failed, kept, and its host's rate."""
    judged = materialise(apply_rules(document_counts(docs, host), rules), "rule-counts")
    rates = host_rates(judged).withColumnRenamed("host", "host_name").select("host_name", "rate")
    joined = judged.join(bounded(rates), F.col("host").eqNullSafe(F.col("host_name")), "left")
    kept = ~F.col("base_failed") & ~F.col("symbol_failed") & (F.col("rate") < rules.reject_rate) & ~((F.col("rate") >= rules.doubt_rate) & F.col("failed"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("rate", 9).alias("host_rate"))


def keep_passing(docs: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with their columns.

    The rows that can be kept at all are written once with their failures;
    texts are counted once and never shuffled to meet their counts.
    """
    shaped = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.col(host).alias("source"), F.col("text").cast("string").alias("text"))
    judged = apply_rules(document_counts(shaped, "source", "row"), rules)
    out = F.col("base_failed") | F.col("symbol_failed")
    judged = materialise(judged.select("host", "failed", out.alias("out"), F.when(~out, F.col("row")).alias("row")), "rule-rows", compression="zstd")
    verdicts = bounded(host_rates(judged).where(F.col("rate") >= rules.doubt_rate).select(F.col("host").alias("host_name"), "rate"))
    joined = judged.where("NOT out").join(verdicts, F.col("host").eqNullSafe(F.col("host_name")), "left")
    rate = F.coalesce("rate", F.lit(0.0))
    return joined.where((rate < rules.reject_rate) & ~((rate >= rules.doubt_rate) & F.col("failed"))).select("row.*")


#: DuckDB SQL that gives the rows of judge() with the rules' default thresholds.
JUDGE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), win AS (
  SELECT k, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5
), keyed AS (
  SELECT k, i, array_to_string(words[i : i + 4], ' ') AS g FROM win
), twice AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM keyed) WHERE n > 1
), rep AS (
  SELECT k, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM twice) GROUP BY k
), c AS (
  SELECT w.k, doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN rep ON rep.k = w.k
), j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 100 * n_symbols > 50 * n_words AS symbol_failed,
         100 * n_dup_lines > 50 * n_lines AS lines_failed FROM c
), h AS (
  SELECT source, count(*) AS n, sum(CAST(base_failed OR symbol_failed OR lines_failed AS BIGINT)) AS f FROM j GROUP BY source
), p AS (
  SELECT avg(f / n) AS m, var_pop(f / n) AS v, avg(n) AS size FROM h
), s AS (
  SELECT m, CASE WHEN v > 1e-12 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE size END AS t FROM p
), r AS (
  SELECT source, (f + t * m) / (n + t) AS rate FROM h, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT symbol_failed AND rate < 0.6 AND NOT (rate >= 0.4 AND (base_failed OR symbol_failed OR lines_failed)) AS kept, round(rate, 9) AS host_rate
FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source
"""
