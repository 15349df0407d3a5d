"""Questions in mixed Bengali and English, and shorthand, as plain English: Column expressions.

Phrases are replaced list by list, and within a list the longest first, those of
equal length in the list's order; words and letters follow.  Nothing is deleted
but particles.  A null stays null, and a blank text stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions import mixed_words as M

#: The zero of the Bengali digits; the others follow it.
_ZERO = 0x09E6
DIGITS = "".join(chr(_ZERO + k) for k in range(10))
BENGALI = "[\\x{0980}-\\x{09FF}]"


def longest_first(words: dict[str, str]) -> list[tuple[str, str]]:
    """The pairs of a list, as they are replaced: a replacement stands apart from its neighbours."""
    return [(a, f" {b} " if b else " ") for a, b in sorted(words.items(), key=lambda x: -len(x[0]))]


#: All phrases, in the order in which they are replaced.
REPLACED = [pair for words in (M.LOANWORDS, M.PRODUCT_WORDS, M.INTENT_WORDS) for pair in longest_first(words)]
#: Letters: pairs first.
SOUNDED = sorted(M.LETTERS.items(), key=lambda x: -len(x[0]))


def _replaced(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Every pair's first part replaced by its second, one pair after the other."""
    table = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in pairs))
    return F.aggregate(table, text, lambda x, pair: F.replace(x, pair[0], pair[1]))


def _words(text: Column, table: dict[str, str], other: str) -> Column:
    """The words of a text, those of ``table`` replaced; characters of the class ``other`` don't count in the look-up."""
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    words = F.split(text, r"(?U)\s+")
    found = F.transform(words, lambda w: F.coalesce(F.element_at(known, F.regexp_replace(F.lower(w), other, "")), w))
    return F.array_join(F.filter(found, lambda w: w != ""), " ")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def plain_english(text: Column) -> Column:
    """A question with Bengali words, letters and digits, and Bengali words in Latin letters, in English."""
    own = _stripped(text)
    latin = lambda x: _words(x, M.LATIN_INTENT_WORDS, "[^a-zA-Z0-9]")
    english = latin(_replaced(F.translate(own, DIGITS, "0123456789"), REPLACED))
    fixed = _words(_replaced(english, SOUNDED), M.SOUND_FIXES, "[^a-z]")
    mixed = _stripped(F.regexp_replace(fixed, r"[?!.]+$", ""))
    return F.when(own == "", text).when(own.rlike(BENGALI), mixed).otherwise(latin(own))


def widened(text: Column) -> Column:
    """A question in lower case with shorthand spelt out and policy phrases widened."""
    own = _stripped(text)
    bare = _stripped(F.regexp_replace(F.lower(own), r"[?!.]+$", ""))
    return F.when(own == "", text).otherwise(_words(_replaced(bare, M.PHRASES.items()), M.SHORTHAND, "[^a-z0-9]"))
