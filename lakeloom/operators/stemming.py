"""Texts as stems of English words without stop words: the published Porter2 (Snowball English) stemmer."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The stemmer's published tables, and the usual English stop words.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STARTS = ("gener", "commun", "arsen")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for
    with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all
    any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
# End of the fixed values.

_WORD = re.compile("[a-z0-9]+")
_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _region(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _marked(word: str) -> str:
    """``word`` with each y that is a consonant, the first letter or one after a vowel, as Y."""
    out = ""
    for c in word:
        out += "Y" if c == "y" and (not out or out[-1] in "aeiouy") else c
    return out


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    for end in ("eedly", "eed"):
        if w.endswith(end):
            return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    for end in ("ingly", "edly", "ing", "ed"):
        if w.endswith(end):
            base = w[: -len(end)]
            if not _VOWEL.search(base):
                return w
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if base[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                return base[:-1]
            return base + "e" if r1 >= len(base) and _SHORT.search(base) else base
    return w


def _suffix(w: str, r1: int, r2: int, table: dict[str, str]) -> str:
    for end in sorted(table, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            allowed = len(base) >= r1 and (end != "ogi" or base.endswith("l")) and (end != "li" or base[-1:] in set("cdeghkmnrt")) and (end != "ative" or len(base) >= r2)
            return base + table[end] if allowed else w
    return w


def _ending(w: str, r2: int) -> str:
    for end in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            return base if len(base) >= r2 and (end != "ion" or base.endswith(("s", "t"))) else w
    return w


def stem(word: str) -> str:
    """The stem of a word of lower-case letters and digits."""
    if len(word) < 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = _marked(word)
    r1 = next((len(s) for s in STARTS if w.startswith(s)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    w = _plural(w)
    if w in KEPT:
        return w
    w = _past(w, r1)
    if w[-1] in "yY" and len(w) > 2 and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    w = _ending(_suffix(_suffix(w, r1, r2, STEP_2), r1, r2, STEP_3), r2)
    if w.endswith("e"):
        base = w[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _SHORT.search(base)):
            w = base
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


class _Known(dict):
    """The stems of the words seen so far, each made once; a stop word's is empty."""

    def __missing__(self, word: str) -> str:
        if len(self) >= 500_000:
            self.clear()
        self[word] = out = "" if word in STOP_WORDS else stem(word)
        return out


def stems(text: str | None, known: _Known | None = None) -> list[str]:
    """The stems of a text's words of ASCII letters and digits, in order, without stop words."""
    known = _Known() if known is None else known
    return list(filter(None, map(known.__getitem__, _WORD.findall((text or "").lower()))))


def stemmed(rows: DataFrame, id_col: str, text_col: str, first: int | None = None) -> DataFrame:
    """(id_col, text_col): each text as its stems, joined by spaces; with ``first``, only so many different ones.

    A null or empty text, or one of stop words alone, is empty; null ids stay.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            found = [stems(t, known) for t in batch.column(1).to_pylist()]
            texts = [" ".join(x if first is None else list(dict.fromkeys(x))[:first]) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, text_col])

    return rows.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{id_col} long, {text_col} string")
