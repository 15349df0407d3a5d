import re
from collections import Counter

from lakeloom.llm.quality_rules import apply_rules, document_counts, host_rates, judge


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {k for i, w in enumerate(windows) if n[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = ["", None, "   \n\t ", "a b c d e", "a b c d e a b c d e", "x " * 40, "one two three four five six " * 3 + "end", "l1\nl1\n\n \nl2 é ü", "### $$ a|b <c>", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "a b a b a b a b a b c", "tab\tsep\x0bvt\x0cff\rcr"]


def test_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "h", "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, n_words string")
    for r in document_counts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def test_hosts(spark):
    good = "word one two three four five six seven eight nine ten"
    rows = [(i, good, "clean") for i in range(50)] + [(100 + i, "bad", "junk") for i in range(45)] + [(200 + i, good, "junk") for i in range(5)] + [(300, good, None), (300, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {r.host: r.rate for r in host_rates(apply_rules(document_counts(docs))).collect()}
    assert rates["clean"] < 0.2 < 0.7 < rates["junk"] < 0.9 and rates[None] > 0
    kept = {r.doc_id: r.kept for r in judge(docs).collect()}
    assert kept[0] and not kept[100] and not kept[200]
    assert judge(docs).count() == len(rows)


def test_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(None, None, None), (1, None, "a")], "doc_id long, text string, source string")
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in judge(docs).collect())
    assert judge(docs.limit(0)).count() == 0
