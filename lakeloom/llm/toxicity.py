"""Toxicity by a learned, weighted lexicon and Aho-Corasick.

Text is folded first: lower case, look-alike letters of other scripts and
accents to their plain letter, digits and signs that stand for letters to that
letter (``fold_text``), everything else to single spaces.  The lexicon is
learned from a bounded sample of labelled rows (``max_rows``; copies and near
copies of one label, by 5-word shingles, count once): whole words and word
beginnings that toxic texts have and clean ones lack, far beyond chance, with
their log odds as weights.  Exception phrases are a short fixed list, and the
pairs of words, one of them in the lexicon, that clean texts have and no toxic
one has, beyond chance too.  Scoring runs one automaton over each whole text,
skips matches inside exception phrases, adds the weights up, divides by a slowly
growing function of the text's length, and maps the result to 0..1 with a
fitted logistic curve.

Defined results: a null or empty text has no match and scores as a clean one;
a null id is scored and stays null; repeated rows are scored alike; rows with a
null label aren't learned from; without any toxic label the lexicon is empty
and every score is low; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import labelled_sample, map_texts, materialise
from lakeloom.llm.jaccard_join import Config as JoinConfig
from lakeloom.llm.jaccard_join import jaccard_components

#: Letters of other scripts, digits and signs, with the letter each stands for.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ɩ": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "l": "i",
}
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "scum line", "worthless check")


class _Folder(dict):
    """Code point -> folded text, worked out on first sight."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        c = plain[0].lower()[:1] if len(plain) == 1 else c
        out = LOOKALIKES.get(c, c if c.isalnum() else " ")
        if unicodedata.combining(chr(code)) or unicodedata.category(chr(code)) == "Cf":
            out = ""  # accents of their own, and invisible joiners
        self[code] = out
        return out


_FOLD = _Folder()
_SIGNS = re.compile(r"(?<=\w)[!|](?=\w)")


def fold_text(text: str) -> str:
    """Folded words, one space between and around them."""
    if "!" in text or "|" in text:
        text = _SIGNS.sub("i", text)
    return " " + " ".join(text.lower().translate(_FOLD).split()) + " "


@dataclass(frozen=True)
class Config:
    """Bounds and thresholds; ``max_rows`` bounds the labelled sample, and with it the lexicon."""

    max_rows: int = 20_000
    stem: tuple[int, int] = (4, 7)
    purity: float = 0.8
    chance: float = 1e-2
    seed: int = 11


@dataclass
class Lexicon:
    """Patterns over folded text (" stem" or " word ") with weights; slope and intercept of the curve."""

    weights: dict[str, float]
    slope: float = 1.0
    intercept: float = -3.0
    exceptions: tuple[str, ...] = field(default=EXCEPTIONS)


def _candidates(text: str, stem: tuple[int, int]) -> set[str]:
    out = set()
    for w in set(fold_text(text).split()):
        out.add(f" {w} ")
        for n in range(stem[0], min(stem[1], len(w)) + 1):
            out.add(" " + w[:n])
    return out


def matcher(lexicon: Lexicon):
    """The automaton of a lexicon, or None if it is empty."""
    import ahocorasick

    if not lexicon.weights:
        return None
    found = ahocorasick.Automaton()
    for p, w in lexicon.weights.items():
        found.add_word(p, (len(p), w))
    for p in lexicon.exceptions:
        found.add_word(fold_text(p), (len(fold_text(p)), None))
    found.make_automaton()
    return found


def weigh(text: str, automaton) -> float:
    """Weights of the words matched (the heaviest pattern of each), over 1 + log(1 + words / 100) / 4."""
    folded = fold_text(text)
    words: dict[int, float] = {}
    safe: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(folded):
        start = end - n + 1
        if w is None:
            safe.append((start, end))
        else:
            words[start] = max(w, words.get(start, 0.0))
    if safe:
        words = {s: w for s, w in words.items() if not any(a <= s < b for a, b in safe)}
    return sum(words.values()) / (1 + math.log1p(folded.count(" ") / 100) / 4) if words else 0.0


def _pairs_of_words(text: str, automaton) -> set[str]:
    """The pairs of neighbouring words in a text of which one is matched."""
    folded = fold_text(text)
    words = folded.split()
    starts, at = {}, 1
    for i, w in enumerate(words):
        starts[at - 1] = i  # a pattern begins with the space before its word
        at += len(w) + 1
    hit = {starts[end - n + 1] for end, (n, _) in automaton.iter(folded)}
    return {" ".join(words[i : i + 2]) for h in hit for i in (h - 1, h) if 0 <= i < len(words) - 1}


def _scores(texts: Iterable[str | None], automaton) -> np.ndarray:
    return np.array([weigh(t, automaton) if automaton is not None and t else 0.0 for t in texts], dtype=np.float64)


def _learned_exceptions(sample: DataFrame, lexicon: Lexicon, config: Config) -> tuple[str, ...]:
    """Pairs of words with a matched one that clean texts have and no toxic one has, beyond chance.

    A match is toxic with probability ``purity`` or more, so n clean texts and
    no toxic one have a chance of (1 - purity) ** n at most, for each pair.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = matcher(Lexicon(lexicon.weights, exceptions=()))
        for batch in batches:
            rows = [(p, label) for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in sorted(_pairs_of_words(text or "", automaton))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.int32())], names=["pair", "label"])

    pairs = sample.mapInArrow(counted, "pair string, label int").groupBy("pair").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") != 1).alias("clean"))
    pairs = materialise(pairs, "toxic-pairs")
    least = math.log(max(pairs.count(), 1) / config.chance) / -math.log(1 - config.purity)
    return tuple(sorted(r.pair for r in pairs.where((F.col("toxic") == 0) & (F.col("clean") >= least)).collect()))


def learn(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> Lexicon:
    """A lexicon from (doc_id, text) and (doc_id, label), label 1 for toxic."""
    sample = materialise(labelled_sample(docs, labels, config.max_rows, config.seed).select("doc_id", "text", F.col("label").cast("int").alias("label")), "toxic-labelled")
    classes = jaccard_components(sample, JoinConfig(width=5, percent=80, sketch_bits=18)).select("doc_id", "component_id").distinct()
    sample = sample.join(F.broadcast(classes), "doc_id").groupBy("component_id", "label").agg(F.max("text").alias("text"))  # at most max_rows rows
    sample = materialise(sample.select("text", "label"), "toxic-sample")
    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic:
        return Lexicon({})

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[1 if label == 1 else 0].update(_candidates(text or "", config.stem))
        keys = list(seen[1])  # what no toxic text has is no candidate... but other tasks' may need this task's clean count
        keys += [k for k, n in seen[0].items() if k not in seen[1]]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["term", "toxic", "clean"])

    counts = sample.select("text", "label").repartition(24).mapInArrow(counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 3")
    share = toxic / (toxic + clean) if clean else 0.5
    likely = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    # Chance that a term unrelated to toxicity is so one-sided (Chernoff bound on a binomial share).
    divergence = F.col("toxic") * F.log(likely / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - likely) / (1 - share))).otherwise(0.0)
    n_terms = counts.count()
    limit = math.log(max(n_terms, 1) / config.chance)
    rows = counts.where((likely >= config.purity) & (divergence > limit)).collect()  # of at most max_rows texts
    weights: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.term), r.term)):  # a longer pattern adds nothing to its own beginning
        if not any(r.term[:n] in weights for n in range(2, len(r.term))):
            weights[r.term] = math.log((r.toxic + 0.5) / (toxic + 1)) - math.log((r.clean + 0.5) / (clean + 1))
    lexicon = Lexicon(weights)
    lexicon.exceptions += _learned_exceptions(sample, lexicon, config) if weights else ()

    def weighed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = matcher(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_scores(batch.column(0).to_pylist(), automaton)), batch.column(1)], names=["x", "label"])

    fit = sample.select("text", "label").repartition(24).mapInArrow(weighed, "x double, label int").toPandas()
    x, y = np.log1p(fit["x"].to_numpy()), (fit["label"] == 1).to_numpy().astype(float)
    a, b = 1.0, -1.0
    for _ in range(60):  # Newton's method with a small ridge, as the classes may be separable
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p)
        grad = np.array([(x * (p - y)).sum() + 1e-2 * a, (p - y).sum() + 1e-2 * b])
        hess = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    lexicon.slope, lexicon.intercept = float(max(a, 0.0)), float(b)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, weight): every row's probability, and its normalised sum of weights."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # terms of at most max_rows texts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = matcher(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = _scores(part.column(1).to_pylist(), automaton)
                p = 1 / (1 + np.exp(-(shared.value.slope * np.log1p(x) + shared.value.intercept)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(x)], names=["doc_id", "score", "weight"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double, weight double")
