"""Runs of repeated word sequences, found from Lyndon roots.

A text is a string over its words.  Phase one of Baier's suffix sorter groups the
suffixes by their longest Lyndon prefix: groups are taken from the highest down,
and each gives its context to the nearest suffixes before it that lie in lower
groups.  The lengths of the contexts are the Lyndon array; a second pass with the
order of the words turned round gives the other one.  By the runs theorem every
run has, under one of the two orders, a root that is the longest Lyndon word at
its start, so extending each root to the left and right by longest common
extensions (exact, from ranks of word sequences of lengths 1, 2, 4, ...) finds all.

Only words that can lie in a run are sorted: in a run of at least ``least`` words
and three periods, each sequence of eight words occurs again in the same run.
Stretches in which every eight words occur again in the text are kept, the others
go, and the stretches of many texts are sorted as one string, with a separator of
its own after each: a separator occurs once, so no run of three periods holds one.

Defined results: a null or empty text has no words, no runs and the hash of an
empty text; ties for the strongest run go to the smaller start, then period; rows
are independent, so repeated rows get equal results and null ids (never altered)
stay null; an empty table gives no rows.  Columns beside doc_id and text are not
read.  A task holds one Arrow batch and at most ``block_words`` candidate words,
or those of one text if it has more.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import map_texts, mix64
from lakeloom.llm.merkle import CRC32_SQL

#: Words of the sequences that must occur again: see ``candidate_stretches``.
GRAM = 8


@dataclass(frozen=True)
class Config:
    """A run has at least ``least`` words and ``exponent`` (3 or more) periods."""

    least: int = 24
    exponent: int = 3
    block_words: int = 1 << 18


def lyndon_lengths(ranks: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word at each place: phase one of Baier's suffix sorter."""
    n = len(ranks)
    if not n:
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(ranks, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(ranks[order])) + 1).tolist(), n]
    members = [order[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    size = [1] * len(members)  # words of a group's context
    below, above = [*range(-1, len(members) - 1)], [*range(1, len(members) + 1)]  # neighbours in the order of groups
    above[-1] = -1
    group = np.repeat(np.arange(len(members)), np.diff(edges))
    of = np.empty(n, dtype=np.int64)
    of[order] = group
    of = of.tolist()
    skip = list(range(-1, n - 1))  # of a suffix that is done: towards the nearest one before it that is not
    done = bytearray(n + 1)  # the last entry, at -1, is never done
    now = len(members) - 1
    while now >= 0:
        own = [i for i in members[now] if of[i] == now]
        members[now] = []
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            j = skip[i]
            if done[j]:
                path = [i]
                while done[j]:
                    path.append(j)
                    j = skip[j]
                for k in path:
                    skip[k] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            parts: dict[tuple[int, int], list[int]] = {}
            for j, k in times.items():
                parts.setdefault((-k, of[j]), []).append(j)
            for old in parts if len(parts) == 1 else sorted(parts):
                k, was = -old[0], old[1]
                new = len(members)  # just above the group it leaves, and below those that left it with more
                members.append(parts[old])
                size.append(size[was] + k * size[now])
                below.append(was)
                above.append(above[was])
                if above[was] >= 0:
                    below[above[was]] = new
                above[was] = new
                for j in parts[old]:
                    of[j] = new
        now = below[now]
    return np.array(size, dtype=np.int64)[of]


class _Extensions:
    """Longest common extensions of two places, from ranks of the sequences of 1, 2, 4, ... words."""

    def __init__(self, ids: np.ndarray) -> None:
        self.n, self.levels = len(ids), [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
        while 2 << len(self.levels) - 1 <= self.n:
            half, last = 1 << len(self.levels) - 1, self.levels[-1]
            level = np.unique(last[:-half] * (self.n + 1) + last[half:], return_inverse=True)[1] if len(last) > half else last[:0]
            self.levels.append(level.astype(np.int64))
            if len(level) and level.max() == len(level) - 1:
                break  # all different: longer ones are too

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from ``a`` and from ``b`` on (a < b)."""
        out = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            while True:
                x, y = a + out, b + out
                ok = np.flatnonzero(y < len(level))
                ok = ok[level[x[ok]] == level[y[ok]]]
                out[ok] += 1 << k
                if k + 1 < len(self.levels) or not len(ok):
                    break
        return out

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree up to and without ``a`` and ``b`` (a < b)."""
        out = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            level = self.levels[k]
            while True:
                x, y = a - out - (1 << k), b - out - (1 << k)
                ok = np.flatnonzero(x >= 0)
                ok = ok[level[x[ok]] == level[y[ok]]]
                out[ok] += 1 << k
                if k + 1 < len(self.levels) or not len(ok):
                    break
        return out


def runs_of(ids: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """(start, length, period) of all maximal runs of at least ``least`` words and ``exponent`` (two or more) periods."""
    found = [np.zeros((0, 3), dtype=np.int64)]
    if len(ids) >= least:
        reach = _Extensions(ids)
        ranks = reach.levels[0]
        for turned in (ranks, ranks.max() - ranks):
            period = lyndon_lengths(turned)
            at = np.flatnonzero(np.arange(len(ids)) + period < len(ids))
            period = period[at]
            left, right = reach.before(at, at + period), reach.after(at, at + period)
            length = left + period + right
            ok = length >= np.maximum(least, exponent * period)
            found.append(np.stack([(at - left)[ok], length[ok], period[ok]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def candidate_stretches(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of a text that hold all its runs.

    A run of length L >= 24 and period q, L >= 3 q, has L >= 2 q + 8: each of its
    sequences of eight words occurs again q words before or after, in the run.
    """
    none = np.zeros(0, dtype=np.int64)
    m = len(ids) - GRAM + 1
    if m <= 0:
        return none, none
    with np.errstate(over="ignore"):
        code, step = mix64(ids.astype(np.uint64)), 1
        while step < GRAM:
            code = mix64(code[:-step] * np.uint64(0x9E3779B97F4A7C15) + code[step:])
            step *= 2
    order = np.argsort(code)
    same = code[order][1:] == code[order][:-1]
    again = np.zeros(m + 1, dtype=np.int8)
    again[order[1:][same]] = 1
    again[order[:-1][same]] = 1
    step = np.diff(again, prepend=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + GRAM - 1
    long = ends - starts >= least
    return starts[long], ends[long]


def altered(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a text, a tenth of the texts (by id) made periodic from some word on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


class _Block:
    """Texts whose runs are found together."""

    def __init__(self) -> None:
        self.texts: list[tuple[int, list[bytes], int | None]] = []
        self.pieces: list[tuple[int, int, np.ndarray]] = []
        self.words = 0

    def add(self, words: list[bytes], doc_id: int | None, ids: np.ndarray, config: Config) -> None:
        for a, b in zip(*candidate_stretches(ids, config.least), strict=True):
            self.pieces.append((len(self.texts), int(a), ids[a:b]))
            self.words += int(b - a) + 1
        self.texts.append((len(self.texts), words, doc_id))

    def runs(self, config: Config) -> tuple[np.ndarray, np.ndarray]:
        """(text, start, length, period) of all runs by text, start and period, and each text's bounds in them."""
        if self.pieces:
            top = 1 + max(int(p.max()) for _, _, p in self.pieces)
            line = np.concatenate([x for k, (_, _, p) in enumerate(self.pieces) for x in (p, [top + k])])
            sizes = np.array([len(p) + 1 for _, _, p in self.pieces])
            base = np.cumsum(sizes) - sizes
            found = runs_of(line, config.least, config.exponent)
            piece = np.searchsorted(base, found[:, 0], side="right") - 1
            of, start = (np.array([p[k] for p in self.pieces]) for k in (0, 1))
            rows = np.stack([of[piece], found[:, 0] - base[piece] + start[piece], found[:, 1], found[:, 2]], axis=1)
            rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
        else:
            rows = np.zeros((0, 4), dtype=np.int64)
        return rows, np.searchsorted(rows[:, 0], np.arange(len(self.texts) + 1))

    def batch(self, config: Config) -> pa.RecordBatch:
        rows, edges = self.runs(config)
        out: dict[str, list] = {name: [] for name, _ in SCHEMA}
        for k, words, doc_id in self.texts:
            own = rows[edges[k] : edges[k + 1]]
            strongest: tuple = (None,) * 4
            kept = words
            if len(own):
                # The greatest exact length / period: ties to the smaller start, then period, the order of the rows.
                best = 0
                for r in range(1, len(own)):
                    if own[r, 2] * own[best, 3] > own[best, 2] * own[r, 3]:
                        best = r
                _, start, length, period = own[best].tolist()
                strongest = (start, length, period, 1000 * length // period)
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(gone, own[:, 1] + own[:, 3], 1)
                np.add.at(gone, own[:, 1] + own[:, 2], -1)
                kept = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
            listed = "".join(f"{a},{b},{c}\n" for a, b, c in own[:, 1:].tolist())
            row = (doc_id, len(own), *strongest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in SCHEMA], names=list(out))


SCHEMA = [(name, pa.int64()) for name in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")] + [(name, pa.string()) for name in ("runs_sha256", "collapsed_sha256")]


def periodic_runs(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for every row of (doc_id, text)."""
    if config.least < 3 * GRAM or config.exponent < 3:
        raise ValueError("runs of at least 24 words and three periods")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, held = _Block(), 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_buffer()
                words = altered(raw.to_pybytes().split() if raw is not None else [], doc_id.as_py())
                names: dict[bytes, int] = {}
                ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
                block.add(words, doc_id.as_py(), ids, config)
                held += len(words)
                if held > 4 * config.block_words or block.words > config.block_words:
                    yield block.batch(config)
                    block, held = _Block(), 0
            if block.texts:
                yield block.batch(config)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


#: DuckDB SQL for the rows of periodic_runs() with the default settings: all pairs of equal words, by their distance.
RUNS_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC32_SQL} AS h FROM documents
), g AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS altered, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM d
), t AS (
  SELECT doc_id, n, CASE WHEN altered THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // parts) + 1] END) ELSE w END AS w FROM g
), x AS (
  SELECT doc_id, n, i, w[i + 1] AS word FROM (SELECT doc_id, n, w, unnest(range(0, n)) AS i FROM t)
), p AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM x JOIN x y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), s AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM p
), r AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY ALL
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY 1
)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM t LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
