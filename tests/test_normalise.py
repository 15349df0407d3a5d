import random

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import mixed_words as M
from lakeloom.functions.normalise import DIGITS, longest_first, plain_english, widened


def run(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("text"))).collect()]


def test_worked_examples(spark):
    cases = {
        "মেনস বক্সার কম্বো ৩ পিচ এর দাম কত?": "mens boxer combo 3 piece price how much",
        "মেনস ব্রিপ কম্বো প্রাইস কত?": "mens brief combo price how much",
        "ফেরত policy": "return policy",
        "size chart ache?": "size chart available",  # a Latin word alone
        "Shirt er daam koto!": "Shirt price how much",
        "English stays, as it is!": "English stays, as it is!",
        "টিশার্ট": "tshirt",  # the longer word wins over the one that it holds
        "স্পোর্টস": "sports",
        "এক্সএক্সএল": "XXL",
        "এক্সএল": "XL",
        "কখগ": "kkhg",  # letter by letter
        "নেই!?.": "not available",
        DIGITS: "0123456789",
        "  ": "  ",
        "": "",
        None: None,
    }
    assert run(spark, plain_english, cases) == list(cases.values())


def test_each_phrase_of_each_list(spark):
    """A phrase alone gives its meaning, unless an earlier list has it too."""
    first = {}
    for words in (M.LOANWORDS, M.PRODUCT_WORDS, M.INTENT_WORDS):
        for a, b in words.items():
            first.setdefault(a, b)
    held = lambda a: any(x != a and x in a for x in first)  # noqa: E731  another phrase inside may come first
    alone = {a: b for a, b in first.items() if not held(a)}
    assert len(alone) > 100
    fixed = [" ".join(M.SOUND_FIXES.get(w, w) for w in b.split()) for b in alone.values()]
    assert run(spark, plain_english, alone) == fixed
    assert run(spark, plain_english, [f"ক {x}" for x in M.SOUND_FIXES if x.isalpha()]) == [f"k {y}" for x, y in M.SOUND_FIXES.items() if x.isalpha()]


def test_order_of_equal_and_overlapping_phrases():
    assert longest_first({"ab": "1", "bcd": "2", "cd": "3", "x": ""}) == [("bcd", " 2 "), ("ab", " 1 "), ("cd", " 3 "), ("x", " ")]


def brute(text):
    """The same, a step at a time."""
    import re

    def latin(t):
        out = []
        for w in t.split():
            c = re.sub("[^a-zA-Z0-9]", "", w.lower())
            w = M.LATIN_INTENT_WORDS.get(c, w)
            if w:
                out.append(w)
        return " ".join(out)

    own = text.strip()
    if not re.search("[ঀ-৿]", own):
        return latin(own)
    for k, d in enumerate(DIGITS):
        own = own.replace(d, str(k))
    for words in (M.LOANWORDS, M.PRODUCT_WORDS, M.INTENT_WORDS):
        for a in sorted(words, key=len, reverse=True):
            own = own.replace(a, f" {words[a]} ")
    own, out, i = latin(own), "", 0
    while i < len(own):
        n = 2 if own[i : i + 2] in M.LETTERS else 1
        out += M.LETTERS.get(own[i : i + n], own[i : i + n])
        i += n
    out = " ".join(M.SOUND_FIXES.get(re.sub("[^a-z]", "", w.lower()), w) for w in out.split())
    return re.sub("[?!.]+$", "", out).strip()


@pytest.mark.parametrize("seed", [1, 2])
def test_against_one_step_at_a_time(spark, seed):
    rng = random.Random(seed)
    pieces = [*M.LOANWORDS, *M.PRODUCT_WORDS, *M.INTENT_WORDS, *M.LATIN_INTENT_WORDS, *M.LETTERS, *M.SOUND_FIXES, *DIGITS, "word", "?", "!", ".", "Er,"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 12))).strip() or "x" for _ in range(300)]
    assert run(spark, plain_english, texts) == [brute(t) for t in texts]


def test_widened(spark):
    cases = {
        "ctg?": "Chittagong",
        "poly shirt": "polyester shirt",
        "Return policy?": "return and return and exchange policy refund refund",  # one phrase after the other
        "bd tk  price!!": "Bangladesh taka BDT price",
        "COD avail, plz.": "cash on delivery available please",
        "All variants.": "all variants sizes colors optionss",
        "size guide": "size guide chart measurements",
        "   ": "   ",
        None: None,
    }
    assert run(spark, widened, cases) == list(cases.values())
