"""Chunking of long texts: fixed windows in SQL, and by structure in an Arrow batch function."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The chunk length of each kind of text, and the overlap.
CHUNK_SIZE = {"product_spec": 800, "faq": 1200, "table": 1500, "documentation": 3000, "article": 2500, "text": 2000}
OVERLAP = 200

#: Phrases and how often a page has them if it lists places and stays whole; what tells a chunk's kind, first match first.
ATOMIC = {"opening hours": 2, "google map": 2, "shop no": 2, "floor": 3}
KINDS = {"faq": r"(?im)^Q:\s*[^\n]+", "table": r"[^\n]\|[^\n]", "product_spec": "Price:|SKU:|Brand:|Availability:", "documentation": r"#{1,6}\s"}

_KINDS = {kind: re.compile(p) for kind, p in KINDS.items()}
_HEADING = re.compile(r"#{1,6}\s+\S|[A-Z][A-Z\s]{3,50}:?\s*$")
_RULE = re.compile(r"\s*[-=]{3,}\s*$")


def fixed_chunks(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, chunk): windows of ``size`` characters, each ``overlap`` into the last; none for empty texts."""
    step = size - overlap
    last = F.floor(F.greatest(F.lit(0), F.length(text_col) - overlap - 1) / step)
    starts = F.when(F.length(text_col) > 0, F.sequence(F.lit(0).cast("long"), last.cast("long")))
    rows = docs.select(id_col, text_col, F.explode(starts).alias("chunk_index"))
    return rows.select(id_col, F.col("chunk_index").cast("int").alias("chunk_index"), F.substring(F.col(text_col), (F.col("chunk_index") * step + 1).cast("int"), F.lit(size)).alias("chunk"))


def sections(text: str) -> list[str]:
    """Runs of lines between headings and rules; question and answer, and table rows, stay together."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if _RULE.match(line):
            out.append([])
            continue
        if _HEADING.match(line) and any(x.strip() for x in out[-1]):
            out.append([])
        out[-1].append(line)
    return [s for s in ("\n".join(x).strip() for x in out) if s]


def cut(section: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most ``size``, ended at a sentence in their second half where there is one."""
    pieces, start = [], 0
    while start < len(section):
        end = min(start + size, len(section))
        if end < len(section):
            stop = max(section.rfind(x, start + size // 2, end) for x in (". ", "! ", "? ", "\n"))
            end = stop + 1 if stop > 0 else end
        piece = section[start:end].strip()
        if piece:
            pieces.append(piece)
        if end >= len(section):
            break
        start = max(end - overlap, start + 1)
    return pieces


def is_atomic(text: str) -> bool:
    """Whether a page lists places, so that it must stay one chunk."""
    lower = text.lower()
    return any(lower.count(phrase) >= n for phrase, n in ATOMIC.items())


def kind_of(chunk: str) -> str:
    return next((kind for kind, p in _KINDS.items() if p.search(chunk)), "text")


def typed_chunk(text: str | None) -> list[tuple[str, int, str]]:
    """(kind, parent, chunk): a text's chunks, those too long for their kind cut again; a piece's parent is the chunk it was cut from."""
    out = []
    for parent, chunk in enumerate(semantic_chunk(text)):
        kind = kind_of(chunk)
        pieces = [chunk] if len(chunk) <= CHUNK_SIZE[kind] else cut(chunk, CHUNK_SIZE[kind], OVERLAP)
        out += [(kind, parent, piece) for piece in pieces]
    return out


def typed_chunks(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, chunk_index, total_chunks, kind, parent_index, chunk, carried text columns) of (doc_id, text), where the texts lie.

    A null or empty text has no chunks; a null id stays null.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                found = typed_chunk(text)
                rows += [(at, doc, i, len(found), *c) for i, c in enumerate(found)]
            at, *columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            more = [batch.column(2 + i).take(pa.array(at, pa.int64())) for i in range(len(carried))]
            yield pa.RecordBatch.from_arrays([*[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], *more], names=["doc_id", "chunk_index", "total_chunks", "kind", "parent_index", "chunk", *carried])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("string").alias(c) for c in carried])
    return texts.mapInArrow(run, ", ".join(["doc_id long, chunk_index int, total_chunks int, kind string, parent_index int, chunk string", *[f"{c} string" for c in carried]]))


def semantic_chunk(text: str | None, size: int = CHUNK_SIZE["text"], overlap: int = OVERLAP) -> list[str]:
    """A text's chunks: whole if short or a list of places, else by sections, long ones cut and short neighbours merged."""
    if not text or not text.strip():
        return []
    if len(text) <= size or is_atomic(text):
        return [text.strip()]
    chunks: list[str] = []
    for s in sections(text):
        for piece in [s] if len(s) <= size else cut(s, size, overlap):
            if chunks and len(chunks[-1]) + len(piece) + 1 <= size // 2:
                chunks[-1] = f"{chunks[-1]}\n{piece}"
            else:
                chunks.append(piece)
    return chunks


def semantic_chunks(docs: DataFrame, size: int = CHUNK_SIZE["text"], overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, total_chunks, chunk) of (doc_id, text), a batch at a time where the texts lie."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, index, total, chunks = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = semantic_chunk(text, size, overlap)
                ids += [doc] * len(found)
                index += range(len(found))
                total += [len(found)] * len(found)
                chunks += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(index, pa.int32()), pa.array(total, pa.int32()), pa.array(chunks, pa.string())], names=["doc_id", "chunk_index", "total_chunks", "chunk"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_index int, total_chunks int, chunk string")
