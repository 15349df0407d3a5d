import zlib
from collections import defaultdict

import numpy as np

from lakeloom.llm.packing import Piece, _fill, pack_block, pack_documents
from lakeloom.llm.tokens import WordTokenizer, default_tokenizer


def whole(sequences, lengths):
    found = defaultdict(list)
    for s in sequences:
        for p in s:
            found[p.doc].append((p.start, p.length))
    for d, n in enumerate(lengths):
        at = 0
        for start, length in sorted(found[d]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_block_is_full_and_whole():
    lengths = np.random.default_rng(0).integers(1, 9000, 300)
    sequences, over = pack_block([Piece(i, 0, int(n)) for i, n in enumerate(lengths)])
    assert not over
    whole(sequences, lengths)
    sizes = [sum(p.length for p in s) for s in sequences]
    assert all(n & (n - 1) == 0 and n <= 4096 for n in sizes)


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    pieces = [Piece(i, 0, int(n)) for i, n in enumerate(rng.integers(20, 2000, 2000))]
    sequences, _ = pack_block(pieces, last=False)
    cost = lambda s: sum(p.length + p.length**2 / 4096 for p in s)
    naive, at = [], 0
    flat = np.concatenate([np.full(p.length, p.doc) for p in pieces])
    for at in range(0, len(sequences) * 4096, 4096):
        naive.append(4096 + sum(n * n / 4096 for n in np.unique(flat[at : at + 4096], return_counts=True)[1]))
    assert np.std([cost(s) for s in sequences]) < np.std(naive)


def test_documents_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = ["Hello world, it's a TEST.", "", None, "x" * 30_000 + " end", "a\tb\nc  d\r\ne é ü, fin; «q»... 12,5 don't.", "same", "same"] + ["word " * n for n in (5000, 9000, 1, 4095, 4096)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string").repartition(2)
    rows = pack_documents(docs, block_sequences=2).collect()
    tok = Tokenizer.from_file(default_tokenizer())
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for i, t in enumerate(texts)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(x)
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_piece_goes_to_the_cheapest_sequence_with_room():
    rng = np.random.default_rng(5)
    for _ in range(20):
        pieces = [Piece(i, 0, int(n)) for i, n in enumerate(rng.integers(1, 40, 120))]
        n_full = sum(p.length for p in pieces) // 64
        room, costs, want = [64] * n_full, [0.0] * n_full, [[] for _ in range(n_full)]
        for p in sorted(pieces, key=lambda p: -p.length):
            at, left = 0, p.length
            while left and any(room):
                fits = [i for i in range(n_full) if room[i] >= left] or [i for i in range(n_full) if room[i]]
                i = min(fits, key=lambda i: (costs[i], i))
                n = min(left, room[i])
                want[i].append((p.doc, at, n))
                room[i] -= n
                costs[i] += n + n * n / 64
                at, left = at + n, left - n
        got, _ = _fill(pieces, n_full, 64, 1.0, 1 / 64)
        assert [[(p.doc, p.start, p.length) for p in s] for s in got] == want


def test_ids_are_those_of_plain_tokenizers():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(default_tokenizer()), WordTokenizer(default_tokenizer(), special_names=True)
    parts = list("aKzéİŉǅßΣςıŁ\u0958\u095f\u0301\u0338中\u3000\u00a0 \n\t.,!?;:'\"12<|>😀") + ["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", " the", " don't", ", ", ". "]
    pick = random.Random(7)
    texts = ["hello <|endoftext|> world", "cİ,", "क़, ख़. ", "x" * 5000, "", None] + ["".join(pick.choices(parts, k=pick.randint(1, 12))) for _ in range(20_000)]
    ids, bounds = own.encode(pa.array(texts, pa.string()))
    assert ids[bounds[0] : bounds[1]].tolist() == [3306, 49407, 1002]
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


def test_every_letter_before_punctuation():
    import unicodedata

    import pyarrow as pa
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(default_tokenizer()), WordTokenizer(default_tokenizer(), special_names=True)
    texts = [f"c{chr(c)}, d" for c in range(0x20, 0x3000) if unicodedata.category(chr(c))[0] == "L"]
    ids, bounds = own.encode(pa.array(texts))
    for i, e in enumerate(plain.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == e.ids, texts[i]
