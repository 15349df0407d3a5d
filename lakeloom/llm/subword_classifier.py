"""Quality classifier: supervised subword embeddings.

Words, word pairs and character n-grams are hashed into buckets; each bucket
has a learned vector, a document is the mean of its buckets' vectors, and a
softmax layer turns it into class probabilities.  Training is stochastic
gradient descent in numpy on a bounded sample of labelled rows (``max_rows``,
the rows whose hashed id is smallest), on whole texts.  The sample's features
stay packed on the driver, which opens one text's at a time.

A trained model is linear in the mean, so scoring first multiplies the bucket
vectors by the output layer: one number per bucket and class.  The table of
these (``buckets`` x classes floats, a fixed size) is what is broadcast, and a
document's logits are the mean of its buckets' numbers.  Nothing is shuffled.

A word pair that repeats its word is hashed as one shape, so repetition is a
feature whatever the word.  Defined results: a null or empty text has no
features and gets the classes' prior; a null id is scored and stays null;
repeated rows are scored alike; rows with a null label aren't learned from; if
only one class (or none) is labelled, every document gets the prior; an empty
table gives no rows; other columns, whatever their names, are not read, and
``keep_scored`` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import _BASE, _BYTE_CODES, give_back_memory, labelled_sample, map_texts, mix64, small_batches, span_hashes, string_bytes, tidy, word_spans


@dataclass(frozen=True)
class Config:
    """Sizes and rates; ``max_rows`` bounds the labelled sample that is learned from."""

    buckets: int = 1 << 18
    dim: int = 12
    sizes: tuple[int, ...] = (3, 4)
    epochs: int = 4
    rate: float = 0.4
    max_rows: int = 4000
    seed: int = 7
    slice_bytes: int = 400_000


@dataclass
class Model:
    """``vectors`` (buckets x dim) and ``output`` (dim x classes); ``prior`` per class; ``classes`` in order."""

    classes: list
    prior: np.ndarray
    vectors: np.ndarray
    output: np.ndarray

    def table(self) -> np.ndarray:
        return (self.vectors @ self.output).astype(np.float32)


def features(texts: pa.Array, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature, text of every feature), grouped by kind, in text order within a kind."""
    data, bounds = string_bytes(texts)
    starts, ends, first = word_spans(data, bounds)
    words = span_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    found, owner = [words], [doc]
    with np.errstate(over="ignore"):
        if len(words) > 1:  # pairs of neighbours in one text
            same = doc[1:] == doc[:-1]
            pair = np.where(words[1:] == words[:-1], np.uint64(11), mix64(words[:-1] * np.uint64(_BASE) + words[1:]))
            found.append(pair[same])
            owner.append(doc[1:][same])
        # Character n-grams in words, with a mark on either side of a word: bytes are laid out as <word><word>...
        length = ends - starts + 2
        at = np.cumsum(length) - length
        total = int(length.sum())
        laid = np.full(total, 1, dtype=np.uint8)
        inner = np.ones(total, dtype=bool)
        inner[at] = False
        inner[at + length - 1] = False
        mask = np.zeros(len(data), dtype=bool)
        if len(data):
            step = np.zeros(len(data) + 1, dtype=np.int8)
            step[starts] = 1
            np.add.at(step, ends, -1)
            mask = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        laid[inner] = data[mask]
        codes = _BYTE_CODES[laid]
        word_of = np.repeat(np.arange(len(words)), length)
        left = np.repeat(at + length, length) - np.arange(total)  # bytes from here to the word's end
        for n in config.sizes:
            if total < n:
                continue
            code = np.zeros(total - n + 1, dtype=np.uint64)
            for k in range(n):
                code = code * np.uint64(_BASE) + codes[k : total - n + 1 + k]
            fits = left[: total - n + 1] >= n
            found.append(mix64(code[fits] + np.uint64(n)))
            owner.append(doc[word_of[: total - n + 1][fits]])
    return (np.concatenate(found) % np.uint64(config.buckets)).astype(np.int32), np.concatenate(owner).astype(np.int64)


def text_slices(texts: pa.Array, slice_bytes: int) -> Iterator[tuple[int, pa.Array]]:
    """Pieces of a column of about so many bytes, at least one row each."""
    sizes = np.cumsum([len(x) if x is not None else 0 for x in texts.cast(pa.large_binary()).to_pylist()]) if len(texts) else np.zeros(0)
    row = 0
    while row < len(texts):
        upto = max(int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + slice_bytes, side="right")), row + 1)
        yield row, texts.slice(row, upto - row)
        row = upto


def pack_features(kinds: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending buckets and how often each occurs, compressed: gaps first, as most are small."""
    import zstandard

    return zstandard.compress(np.diff(kinds, prepend=0).astype("<i4").tobytes() + counts.astype("<f4").tobytes(), 3)


def open_features(packed: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """The buckets and counts (float32) of ``pack_features``."""
    import zstandard

    raw = zstandard.decompress(packed)
    half = len(raw) // 2
    return np.cumsum(np.frombuffer(raw[:half], "<i4"), dtype=np.int32), np.frombuffer(raw[half:], "<f4")


def train(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> Model:
    """Learn from (doc_id, text) and (doc_id, label); at most ``max_rows`` labels, featurised on the executors."""
    model = _train(docs, labels, config)
    give_back_memory()
    return model


def _train(docs: DataFrame, labels: DataFrame, config: Config) -> Model:
    sample = labelled_sample(docs, labels, config.max_rows, config.seed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in text_slices(batch.column(1), config.slice_bytes):
                bucket, doc = features(part, config)
                rows = []
                order = np.argsort(doc, kind="stable")
                edges = np.searchsorted(doc[order], np.arange(len(part) + 1))
                for i in range(len(part)):
                    rows.append(pack_features(*np.unique(bucket[order[edges[i] : edges[i + 1]]], return_counts=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(part)), batch.column(2).slice(row, len(part)), pa.array(rows, pa.binary())], names=["doc_id", "label", "features"])

    label_type = sample.schema["label"].dataType.simpleString()
    got = map_texts(sample, run, f"doc_id long, label {label_type}, features binary").toArrow()
    order = pc.sort_indices(got, [("doc_id", "ascending"), ("label", "ascending")])
    labels_ = got["label"].take(order).to_pylist()
    classes = sorted(set(labels_))
    target = np.array([classes.index(x) for x in labels_], dtype=np.int64)
    prior = np.bincount(target, minlength=len(classes)) / max(len(labels_), 1)
    rng = np.random.default_rng(config.seed)
    vectors = rng.random((config.buckets, config.dim), dtype=np.float32)
    vectors *= 2
    vectors -= 1
    vectors /= config.dim
    output = np.zeros((config.dim, max(len(classes), 1)), dtype=np.float32)
    if len(classes) < 2:
        return Model(classes, prior, vectors, output)
    packed = [got["features"][i].as_buffer() for i in order.to_pylist()]
    steps, done = config.epochs * len(packed), 0
    for _ in range(config.epochs):
        for i in rng.permutation(len(packed)):
            kinds, counts = open_features(packed[i])
            rate = config.rate * (1 - done / steps)
            done += 1
            if not len(kinds):
                continue
            share = counts / counts.sum()
            mean = share @ vectors[kinds]
            z = mean @ output
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            back = output @ p
            output -= rate * np.outer(mean, p)
            vectors[kinds] -= (rate * len(kinds) ** 0.5) * np.outer(share, back)  # many features share one step
    return Model(classes, prior, vectors, output)


def scorer(spark: SparkSession, model: Model, config: Config = Config(), positive: object = 1):
    """An Arrow function from texts to the probability of class ``positive``; other columns stay in the JVM."""
    table = spark.sparkContext.broadcast(model.table())
    known = positive in model.classes
    k = model.classes.index(positive) if known else 0
    base = float(model.prior[k]) if known else (0.5 if not model.classes else 0.0)
    learned = known and len(model.classes) > 1

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            scores = np.full(len(texts), base)
            for row, part in text_slices(texts, config.slice_bytes) if learned else ():
                bucket, doc = features(part, config)
                n = np.bincount(doc, minlength=len(part))
                logits = np.stack([np.bincount(doc, weights=t[bucket], minlength=len(part)) for t in np.ascontiguousarray(table.value.T)], axis=1)[n > 0] / n[n > 0, None]
                e = np.exp(logits - logits.max(axis=1, keepdims=True))
                scores[row : row + len(part)][n > 0] = e[:, k] / e.sum(axis=1)
            yield pa.array(scores)

    small_batches(spark)
    tidied = tidy(run)

    @F.arrow_udf("double")
    def score_texts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(columns)

    return score_texts


def score(docs: DataFrame, model: Model, config: Config = Config(), positive: object = 1) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(docs.sparkSession, model, config, positive)(F.col("text").cast("string")).alias("score"))


def keep_scored(docs: DataFrame, model: Model, least: float = 0.5, config: Config = Config(), positive: object = 1) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, with their columns."""
    scored = docs.select(F.struct("*").alias("row"), scorer(docs.sparkSession, model, config, positive)(F.col("text").cast("string")).alias("score"))
    return scored.where(F.col("score") >= least).select("row.*")
