"""Language identification by interpolated Kneser-Ney character models.

One model per language, over letters (lower-cased code points; everything else
is a single space).  The distinct ``order``-grams of all training texts are
counted by the executors, partial counts first; the counts of shorter grams
follow from them, since Kneser-Ney counts a short gram by its distinct left
neighbours.  No gram is dropped.  A text goes to the model with the lowest
cross-entropy per character.

A count of the distinct grams decides how the models are held.  Up to
``broadcast_grams`` they are sorted 64-bit hash arrays, one per order, with
discounted probabilities and back-off weights beside them (``Model``): they are
broadcast, and a look-up is a binary search.  Beyond it they are tables
(``Tables``), and the distinct grams of the texts get their probabilities by
joins, order by order.  In each of these a key has at most as many rows as
there are characters; in the last one, of the grams with the texts, the most
frequent grams are broadcast, so that no key is hot.

``score`` is the softmax over languages of the summed log-probabilities, with
the text's length capped so that it stays a calibrated confidence; ``rejected``
marks texts whose entropy lies beyond what the language's own training texts
show (mean plus four deviations over all of them).

Defined results: a null text or one without letters is ``und`` with score 0; a
null language isn't learned from; repeated rows are scored alike; without any
training text every row is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import _BASE, map_texts, materialise, mix64
from lakeloom.llm.subword_classifier import text_slices


@dataclass(frozen=True)
class Config:
    """``broadcast_grams`` bounds the models that are broadcast, ``hot_grams`` the grams that the joins broadcast."""

    order: int = 4
    discount: float = 0.75
    broadcast_grams: int = 1_000_000
    hot_grams: int = 100_000
    cap: float = 12.0
    slice_bytes: int = 2_000_000


_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def letters(texts: list[str | None], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points, text of each): letters and single spaces, each text after ``pad`` zeros."""
    joined = "".join("\0" * pad + (t or "").replace("\0", " ").lower() for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    code = np.where(_LETTER[code] | (code == 0), code, 32).astype(np.uint32)
    text = (np.cumsum(code == 0) - 1) // pad  # a text starts every ``pad`` zeros
    keep = (code != 32) | np.concatenate([[False], (code[:-1] != 32) & (code[:-1] != 0)])[: len(code)]  # one space after a letter
    return code[keep], text[keep]


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash for each row of a (n, k) array of code points; rows of different width differ."""
    h = np.full(len(codes), np.uint64(codes.shape[1]), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            h = mix64(h * np.uint64(_BASE) + codes[:, k].astype(np.uint64) + np.uint64(1))
    return h


def windows(code: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places): a hash of the ``order`` code points that end at each place with a character."""
    at = np.flatnonzero(code != 0)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(order - 1, -1, -1):
            h = h * np.uint64(_BASE) + code[at - k].astype(np.uint64) + np.uint64(1)
    return mix64(h), at


def distinct(keys: np.ndarray, slots: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, the distinct key of each place), without sorting all of them."""
    slot = (keys & np.uint64(slots - 1)).astype(np.int64)
    holder = np.full(slots, -1, dtype=np.int64)
    holder[slot] = np.arange(len(keys))
    own = keys[holder[slot]] == keys if len(keys) else np.zeros(0, dtype=bool)
    used = np.flatnonzero(holder >= 0)
    number = np.zeros(slots, dtype=np.int64)
    number[used] = np.arange(len(used))
    inverse = number[slot]
    clash = np.flatnonzero(~own)
    _, first, inv = np.unique(keys[clash], return_index=True, return_inverse=True)
    inverse[clash] = len(used) + inv
    return np.concatenate([holder[used], clash[first]]), inverse


@dataclass
class Model:
    """Per language: ``grams[k]`` (sorted hashes, probabilities) and ``contexts[k]`` (sorted hashes, back-off weights)."""

    languages: list[str]
    order: int
    grams: list[list[tuple[np.ndarray, np.ndarray]]]
    contexts: list[list[tuple[np.ndarray, np.ndarray]]]
    uniform: list[float]
    limits: np.ndarray | None = None

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        """(n, languages) log2 probabilities of the last code point of each row given those before."""
        out = np.zeros((len(codes), len(self.languages)))
        hashes = [gram_hashes(codes[:, self.order - k :]) for k in range(1, self.order + 1)]
        before = [None] + [gram_hashes(codes[:, self.order - k : -1]) for k in range(2, self.order + 1)]
        for j in range(len(self.languages)):
            p = np.full(len(codes), self.uniform[j])
            for k in range(self.order):
                weight = self._find(self.contexts[j][k], before[k], 1.0) if k else self.contexts[j][0][1][0]
                p = self._find(self.grams[j][k], hashes[k], 0.0) + weight * p
            out[:, j] = np.log2(p)
        return out

    @staticmethod
    def _find(stored: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, default: float) -> np.ndarray:
        keys, values = stored
        if not len(keys):
            return np.full(len(hashes), default)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, values[at], default)


@dataclass
class Tables:
    """The same as tables: ``grams[k]`` (gram, p) and ``contexts[k]`` (context, weight), arrays with a number per language."""

    languages: list[str]
    order: int
    grams: list[DataFrame]
    contexts: list[DataFrame]
    uniform: list[float]
    limits: np.ndarray | None = None


def count_grams(labelled: DataFrame, order: int, slice_bytes: int) -> DataFrame:
    """(lang, gram, n) over all texts of (text, lang); a gram is ``order`` code points, 0 before the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0), np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                for _, part in text_slices(texts.filter(pa.array(langs == lang)), slice_bytes):
                    code, _ = letters(part.to_pylist(), order - 1)
                    keys, at = windows(code, order)
                    first, inverse = distinct(keys)
                    n = np.bincount(inverse, minlength=len(first))
                    table = np.stack([code[at[first] - k] for k in range(order - 1, -1, -1)], axis=1).astype("<u4")
                    raw = table.tobytes()
                    grams = [raw[i : i + 4 * order] for i in range(0, len(raw), 4 * order)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.binary()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return map_texts(labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), run, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _estimate(codes: np.ndarray, n: np.ndarray, order: int, discount: float) -> tuple[list, list, float]:
    """Sorted hash arrays of one language from its distinct ``order``-grams and their counts."""
    grams: list = [None] * order
    contexts: list = [None] * order
    for k in range(order, 0, -1):
        hashes = gram_hashes(codes)
        if k > 1:
            head, inverse = np.unique(gram_hashes(codes[:, :-1]), return_inverse=True)
        else:
            head, inverse = np.zeros(1, dtype=np.uint64), np.zeros(len(codes), dtype=np.int64)
        total = np.bincount(inverse, weights=n, minlength=len(head))
        kinds = np.bincount(inverse, minlength=len(head))
        p = np.maximum(n - discount, 0) / total[inverse]
        sort = np.argsort(hashes)
        grams[k - 1] = (hashes[sort], p[sort])
        contexts[k - 1] = (head, discount * kinds / total)
        if k > 1:  # a shorter gram counts its distinct left neighbours
            codes, n = np.unique(codes[:, 1:], axis=0, return_counts=True)
            n = n.astype(np.float64)
    return grams, contexts, 1.0 / (len(grams[0][0]) + 1)


def _head(k: int) -> Column:
    """All but the last of a gram's ``k`` code points."""
    return F.substring("gram", 1, 4 * (k - 1))


def _tail(k: int) -> Column:
    """All but the first of a gram's ``k`` code points."""
    return F.substring("gram", 5, 4 * (k - 1))


def _estimate_tables(grams: DataFrame, languages: list[str], config: Config) -> Tables:
    """What ``_estimate`` gives, by aggregates and joins over (lang, gram, n)."""

    def by_language(df: DataFrame, key: str, value: str, default: float) -> DataFrame:
        each = [F.coalesce(F.max(F.when(F.col("lang") == x, F.col(value))), F.lit(default)) for x in languages]
        return materialise(df.groupBy(key).agg(F.array(*each).alias(value)), f"kn-{value}")

    tables: list = [None] * config.order
    contexts: list = [None] * config.order
    for k in range(config.order, 0, -1):
        heads = grams.groupBy("lang", _head(k).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        joined = grams.withColumn("context", _head(k)).join(F.broadcast(heads) if k == 1 else heads, ["lang", "context"])  # one head a language at k = 1
        tables[k - 1] = by_language(joined.select("lang", "gram", (F.greatest(F.col("n") - F.lit(config.discount), F.lit(0.0)) / F.col("total")).alias("p")), "gram", "p", 0.0)
        contexts[k - 1] = by_language(heads.select("lang", "context", (F.lit(config.discount) * F.col("kinds") / F.col("total")).alias("weight")), "context", "weight", 1.0)
        if k > 1:  # a shorter gram counts its distinct left neighbours
            grams = materialise(grams.groupBy("lang", _tail(k).alias("gram")).agg(F.count("*").alias("n")), "kn-grams")
    known = {r.lang: r.n for r in grams.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    return Tables(languages, config.order, tables, contexts, [1.0 / (known[x] + 1) for x in languages])


def _estimate_arrays(rows, languages: list[str], config: Config) -> Model:
    """The models from all (lang, gram, n) in memory."""
    parts = []
    for lang in languages:
        own = rows[rows["lang"] == lang].sort_values("gram")
        codes = np.frombuffer(b"".join(map(bytes, own["gram"])), dtype="<u4").reshape(-1, config.order)
        parts.append(_estimate(codes, own["n"].to_numpy(np.float64), config.order, config.discount))
    return Model(languages, config.order, [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts])


def train(labelled: DataFrame, config: Config = Config()) -> Model | Tables:
    """Models of every language in (doc_id, text, lang) rows; counts and limits cover all of them."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("lang", F.col("lang").cast("string"))
    grams = materialise(count_grams(known, config.order, config.slice_bytes), "kn-grams")
    languages = sorted(r.lang for r in grams.select("lang").distinct().collect())
    if grams.limit(config.broadcast_grams + 1).count() <= config.broadcast_grams:
        model = _estimate_arrays(grams.toPandas(), languages, config)
    else:
        model = _estimate_tables(grams, languages, config)
    if languages:
        own = _score(known, model, config, extra="lang").where("lang_pred = lang AND NOT isnan(entropy)").groupBy("lang").agg(F.avg("entropy").alias("m"), F.stddev_pop("entropy").alias("s")).collect()
        limit = {r.lang: r.m + 4 * r.s + 0.5 for r in own}
        model.limits = np.array([limit.get(x, np.inf) for x in languages])
    return model


def _verdicts(ids: pa.Array, total: np.ndarray, n: np.ndarray, has: np.ndarray, languages: list[str], limits: np.ndarray | None, cap: float, extra: pa.Array | None) -> pa.RecordBatch:
    """The rows of a batch from each text's log-probabilities by language, its characters and whether it has letters."""
    entropy = -total / np.maximum(n, 1)[:, None]
    best = entropy.argmin(axis=1)
    z = -(entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(n, cap)[:, None]
    p = 1 / np.exp2(z).sum(axis=1)
    low = entropy[np.arange(len(n)), best]
    over = low > limits[best] if limits is not None else np.zeros(len(n), dtype=bool)
    names = [languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
    out = [ids, pa.array(names, pa.string()), pa.array(np.where(has, p, 0.0)), pa.array(np.where(has, low, np.nan)), pa.array(~has | over)]
    columns = ["doc_id", "lang_pred", "score", "entropy", "rejected"]
    return pa.RecordBatch.from_arrays(out if extra is None else [*out, extra], names=columns if extra is None else [*columns, "lang"])


def _text_grams(part: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct grams, gram of each character, text of each character, characters a text, whether a text has letters)."""
    code, text = letters(part.to_pylist(), order - 1)
    keys, at = windows(code, order)
    first, inverse = distinct(keys)
    table = np.stack([code[at[first] - k] for k in range(order - 1, -1, -1)], axis=1) if len(first) else np.zeros((0, order), dtype=np.uint32)
    n = np.bincount(text[at], minlength=len(part)) if len(at) else np.zeros(len(part), dtype=np.int64)
    has = np.zeros(len(part), dtype=bool)
    has[text[at][code[at] != 32]] = True
    return table, inverse, text[at], n, has


_SCORED = "doc_id long, lang_pred string, score double, entropy double, rejected boolean"


def _score(docs: DataFrame, model: Model | Tables, config: Config, extra: str | None = None) -> DataFrame:
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")] + ([F.col(extra)] if extra else [])
    score = _score_joined if isinstance(model, Tables) else _score_broadcast
    return score(docs.select(*columns), model, config, _SCORED + (", lang string" if extra else ""))


def _score_broadcast(docs: DataFrame, model: Model, config: Config, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by broadcast_grams

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for row, part in text_slices(batch.column(1), config.slice_bytes):
                table, inverse, text, n, has = _text_grams(part, m.order)
                lp = m.log_prob(table)
                total = np.stack([np.bincount(text, weights=lp[inverse, j], minlength=len(part)) for j in range(len(m.languages))], axis=1)
                extra = batch.column(2).slice(row, len(part)) if batch.num_columns > 2 else None
                yield _verdicts(batch.column(0).slice(row, len(part)), total, n, has, m.languages, m.limits, config.cap, extra)

    return map_texts(docs, run, schema)


def _gram_values(grams: DataFrame, model: Tables, k: int) -> DataFrame:
    """(gram, value): the probabilities by language of distinct grams of ``k`` code points, from those of their tails."""
    many = range(len(model.languages))
    if k == 1:
        first = model.contexts[0].first().weight
        lower = [F.lit(first[j] * model.uniform[j]) for j in many]
        joined = grams.join(model.grams[0], "gram", "left")
    else:
        shorter = _gram_values(grams.select(_tail(k).alias("gram")).distinct(), model, k - 1)
        joined = grams.withColumn("context", _head(k)).withColumn("tail", _tail(k)).join(model.grams[k - 1], "gram", "left").join(model.contexts[k - 1], "context", "left")
        joined = joined.join(shorter.select(F.col("gram").alias("tail"), F.col("value").alias("below")), "tail")
        lower = [F.coalesce(F.col("weight")[j], F.lit(1.0)) * F.col("below")[j] for j in many]
    value = F.array(*[F.coalesce(F.col("p")[j], F.lit(0.0)) + lower[j] for j in many])
    return joined.select("gram", value.alias("value"))


def _score_joined(docs: DataFrame, model: Tables, config: Config, schema: str) -> DataFrame:
    order, languages, limits, cap, slice_bytes = model.order, model.languages, model.limits, config.cap, config.slice_bytes
    fields = [f for f in docs.columns if f != "text"]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in text_slices(batch.column(1), slice_bytes):
                table, inverse, text, n, has = _text_grams(part, order)
                pair, times = np.unique(text.astype(np.int64) * max(len(table), 1) + inverse, return_counts=True)
                owner, gram = pair // max(len(table), 1), pair % max(len(table), 1)
                bounds = pa.array(np.searchsorted(owner, np.arange(len(part) + 1)), pa.int32())
                raw = table.astype("<u4").tobytes()
                names = pa.array([raw[i : i + 4 * order] for i in range(0, len(raw), 4 * order)], pa.binary()).take(pa.array(gram, pa.int64()))
                rest = [batch.column(i).slice(row, len(part)) for i in range(batch.num_columns) if i != 1]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(has), pa.ListArray.from_arrays(bounds, names), pa.ListArray.from_arrays(bounds, pa.array(times, pa.int64()))], names=[*fields, "n", "has", "grams", "times"])

    counted = map_texts(docs, count, "doc_id long" + (", lang string" if "lang" in fields else "") + ", n long, has boolean, grams array<binary>, times array<long>")
    rows = materialise(counted.withColumn("row", F.monotonically_increasing_id()), "kn-texts")  # written: the numbers stay
    pairs = rows.select("row", F.explode(F.arrays_zip("grams", "times")).alias("x")).select("row", F.col("x.grams").alias("gram"), F.col("x.times").alias("times"))
    known = materialise(pairs.groupBy("gram").agg(F.count("*").alias("texts")), "kn-text-grams")
    logs = F.transform("value", F.log2).alias("lp")
    values = materialise(known.join(_gram_values(known.select("gram"), model, order), "gram").select("gram", "texts", logs), "kn-values")
    hot = F.broadcast(materialise(values.orderBy(F.desc("texts"), "gram").limit(config.hot_grams).select("gram", "lp"), "kn-hot"))
    both = pairs.join(hot, "gram").unionByName(pairs.join(hot.select("gram"), "gram", "left_anti").join(values.select("gram", "lp"), "gram"))
    totals = both.groupBy("row").agg(F.array(*[F.sum(F.col("times") * F.col("lp")[j]) for j in range(len(languages))]).alias("total"))

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            none = [0.0] * len(languages)  # a text without grams
            total = np.array([x if x is not None else none for x in batch.column("total").to_pylist()], dtype=np.float64)
            n, has = batch.column("n").to_numpy(), batch.column("has").to_numpy(zero_copy_only=False)
            yield _verdicts(batch.column("doc_id"), total, n, has, languages, limits, cap, batch.column("lang") if "lang" in fields else None)

    return map_texts(rows.join(totals, "row", "left").select(*fields, "n", "has", "total"), decide, schema)


def identify(docs: DataFrame, model: Model | Tables, config: Config = Config()) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) for every row."""
    if not model.languages:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(float("nan")).alias("entropy"), F.lit(True).alias("rejected"))
    return _score(docs, model, config)
