"""Token ids of Arrow text columns, through the public vocabulary files.

The whole-word cache makes use of two facts of the vocabulary: white space
separates words, and a run of ASCII punctuation and symbols without an
apostrophe that follows a Latin letter and ends a word is a token group of its
own (not so after letters whose lower case or normal form ends in a mark, so
words of other scripts are encoded whole; an apostrophe can begin a group with
letters).  So such a text's ids are its words' ids, one after the other, and a
word that was seen before costs a look-up.  The cache only saves time: its bound
changes no result.

The name of a special token in a text is either its id, as plain ``tokenizers``
has it (``special_names``; such texts are encoded whole), or ordinary text.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a Python worker remembers, about 170 bytes each; all are forgotten beyond that or ten times as many ids.
CACHE_WORDS = 300_000

#: A Latin letter that stays one letter, the punctuation after it, and the word's end; U+0130 turns into a letter and a mark.
_WORD_END = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([!-&(-/:-@\[-`{-~]+)(\s|$)"


def default_tokenizer() -> str:
    """The path of the public word-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_table() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_LETTERS = _byte_table()


def _byte_letters(word: str) -> str | None:
    """A word of Latin letters as the vocabulary's merges want it; None for any other word.

    Normalising and splitting only make such a word's letters small, so the
    merges alone give its ids.
    """
    if word.isascii():
        return word if word.isalpha() and word.islower() else None
    word = word.lower()
    if word.isalpha() and max(word) < "\u0250":
        return "".join([_LETTERS[b] for b in word.encode()])
    return None


class WordTokenizer:
    """Encodes string columns; one per Python worker, vocabulary file and ``special_names`` (see ``tokenizer``)."""

    def __init__(self, path: str, special_names: bool = False, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = not special_names
        self._names = [t.content.lower() for t in self._tok.get_added_tokens_decoder().values()] if special_names else []
        self._merge = self._tok.model.tokenize
        self._cache_words = cache_words
        self._forget()

    def _forget(self) -> None:
        self._cache: dict[str, int] = {}  # a word's number
        self._ids = array("I")  # the words' ids by their numbers, one after the other
        self._ends = array("q", [0])  # where the ids of the word before each number end

    def _remember(self, word: str, ids: list[int]) -> None:
        self._cache[word] = len(self._ends) - 1
        self._ids.extend(ids)
        self._ends.append(len(self._ids))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, bounds of each row); null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        named = np.zeros(len(texts), dtype=bool)
        for name in self._names:
            named |= pc.match_substring(texts, name, ignore_case=True).to_numpy(zero_copy_only=False)
        if not named.any():
            return self._encode(texts)
        ids, bounds = self._encode(pc.if_else(pa.array(named), "", texts))
        rows = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in np.flatnonzero(named):
            rows[i] = np.array(self._tok.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = pc.replace_substring_regex(texts, _WORD_END, r"\1 \2\3")
        x = pc.replace_substring(pc.ascii_lower(x), "\n", " ")
        split = pc.split_pattern(x, " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist()
        missing = [w for w in words if w not in self._cache]
        if len(self._cache) + len(missing) > self._cache_words or len(self._ids) > 10 * self._cache_words:
            self._forget()
            missing = words
        rest = []
        for w in missing:
            letters = _byte_letters(w)
            if letters is None:
                rest.append(w)
            else:
                self._remember(w, [t.id for t in self._merge(letters)])
        for i in range(0, len(rest), 2_000):  # encodings hold far more than ids: few at a time
            part = rest[i : i + 2_000]
            for w, e in zip(part, self._tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self._remember(w, e.ids)
        if not words:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        numbers = np.fromiter(map(self._cache.__getitem__, words), dtype=np.int64, count=len(words))
        flat, ends = np.frombuffer(self._ids, dtype=np.uint32), np.frombuffer(self._ends, dtype=np.int64)
        starts, lens = ends[numbers], ends[numbers + 1] - ends[numbers]
        idx = coded.indices.to_numpy(zero_copy_only=False)
        sizes = lens[idx]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.arange(total[-1]) - np.repeat(total[:-1] - starts[idx], sizes)]
        offsets = split.offsets.to_numpy(zero_copy_only=False)
        return ids, total[offsets - offsets[0]]


@lru_cache(maxsize=2)
def tokenizer(path: str, special_names: bool = False) -> WordTokenizer:
    """The worker's tokenizer for a vocabulary file; it lives as long as the worker."""
    return WordTokenizer(path, special_names)


def encode_with_end(texts: pa.Array, path: str, end_id: int, special_names: bool = False, slice_chars: int = 1_000_000):
    """Yield (first row, ids, bounds) for slices of a column; each row's ids end with ``end_id``.

    Slices hold about ``slice_chars`` bytes, so that a batch of very long texts stays small.
    """
    lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    row = 0
    while row < len(texts):
        base = lengths[row - 1] if row else 0
        upto = max(int(np.searchsorted(lengths, base + slice_chars, side="right")), row + 1)
        ids, bounds = tokenizer(path, special_names).encode(texts.slice(row, upto - row))
        ids = np.insert(ids, bounds[1:], np.uint32(end_id))
        yield row, ids, bounds + np.arange(len(bounds))
        row = upto
        pa.default_memory_pool().release_unused()
