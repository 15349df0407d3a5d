import numpy as np
import pytest

from lakeloom.llm.token_counts import count_document_tokens, separator_scan
from lakeloom.llm.tokens import default_tokenizer
from lakeloom.llm.training_order import feistel_slots, read_sequences, write_training_order

TEXTS = ["one two three", "", None, "same text", "same text", "word " * 3000, "a, b. c; d! <|endoftext|> x"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, file string").repartition(2)


def expected():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    tok.encode_special_tokens = True
    return {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}


def test_counts_against_the_tokenizer(spark, docs, tmp_path):
    rows = count_document_tokens(docs, f"file://{tmp_path}/t").collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(x) for i, x in expected().items()}


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = set()
    for f in range(3):
        ids = rng.integers(0, 4, 60).astype("<u2")
        ids.tofile(tmp_path / f"x{f}.bin")
        start = ordinal = 0
        for i, x in enumerate(ids):
            if x == 3:
                want.add((f"x{f}.bin", ordinal, start, i - start, True))
                start, ordinal = i + 1, ordinal + 1
        if start < len(ids):
            want.add((f"x{f}.bin", ordinal, start, len(ids) - start, False))
    (tmp_path / "empty.bin").touch()
    got = separator_scan(spark, str(tmp_path), end_id=3, block_tokens=block).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_scan_of_odd_and_empty(spark, tmp_path):
    assert separator_scan(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "a.bin").write_bytes(b"abc")
    with pytest.raises(ValueError):
        separator_scan(spark, str(tmp_path))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = feistel_slots(np.arange(n), n, key=7)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 100:
        assert not np.array_equal(slots, feistel_slots(np.arange(n), n, key=8))
        assert slots[17] == feistel_slots(np.array([17]), n, key=7)[0]


def test_shards_hold_all_tokens_and_resume(spark, docs, tmp_path):
    folder, options = f"file://{tmp_path}/s", {"seq_len": 64, "shard_rows": 16}
    rows = write_training_order(docs, folder, key=3, **options).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n))
    all_rows = list(read_sequences(folder, 0, n, **options))
    assert len(all_rows) == n
    assert all(np.array_equal(x, y) for x, y in zip(all_rows[20:], read_sequences(folder, 20, n, **options), strict=True))
    by_index = [all_rows[r.slot][: r.n_real] for r in sorted(rows, key=lambda r: r["index"])]
    stream = np.concatenate(by_index)
    found, start = [], 0
    for end in np.flatnonzero(stream == 49407):
        found.append(tuple(stream[start:end].tolist()))
        start = end + 1
    assert start == len(stream)
    assert sorted(found) == sorted(tuple(x) for x in expected().values())
    assert {d for r in rows for d in r.doc_ids} == set(range(len(TEXTS)))


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert write_training_order(none, f"file://{tmp_path}/a").count() == 0
    assert count_document_tokens(none, f"file://{tmp_path}/b").count() == 0
