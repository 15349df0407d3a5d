import random

import pyarrow as pa
from tokenizers import Tokenizer

from lakeloom.llm.tokens import WordTokenizer, _byte_letters, default_tokenizer


def plain_ids(texts):
    return [e.ids for e in Tokenizer.from_file(default_tokenizer()).encode_batch(texts, add_special_tokens=False)]


def rows(own, texts):
    ids, bounds = own.encode(pa.array(texts))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_many_words_are_merged_once():
    pick = random.Random(3)
    texts = [" ".join("".join(pick.choices("abcdefghijklmnopqr", k=9)) for _ in range(1000)) for _ in range(200)]
    own = WordTokenizer(default_tokenizer())
    merge, merged = own._merge, []
    own._merge = lambda word: merged.append(word) or merge(word)
    for _ in range(2):
        for i in range(0, len(texts), 50):
            rows(own, texts[i : i + 50])
    assert len(merged) == len(set(merged)) == len({w for t in texts for w in t.split()})


def test_words_that_need_no_whole_encoding():
    own = WordTokenizer(default_tokenizer())
    texts = [f"{w}{p}" for w in ("abc", "Éxyz", "ñandú", "ÖL") for p in ("", "###", "&&&", "$%|", ",***", ">]`~")]
    assert rows(own, texts) == plain_ids(texts)
    assert all(_byte_letters(w) for w in own._cache if any(c.isalpha() for c in w))


def test_forgetting_changes_no_ids():
    pick = random.Random(4)
    parts = list("abzZéÉİß#$%&'\"`~[]{}|<>=-_/\\@^*()+., \n\t0中ж̸́") + ["'s", "'ll", "<|endoftext|>"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 15))) for _ in range(5_000)] + ["ж" * 3_000, "中" * 3_000]
    own = WordTokenizer(default_tokenizer(), special_names=True, cache_words=300)
    found = [ids for i in range(0, len(texts), 40) for ids in rows(own, texts[i : i + 40])]
    assert found == plain_ids(texts)
