import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lakeloom.llm.periodic_runs import Config, candidate_stretches, lyndon_lengths, periodic_runs, runs_of


def brute_runs(s, least=24, exponent=3):
    n, out = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if s[i] == s[i + q]:
                j = i
                while j + q < n and s[j] == s[j + q]:
                    j += 1
                if j + q - i >= max(least, exponent * q):
                    out.setdefault((i, j + q - i), q)
                i = j
            i += 1
    return sorted((a, length, q) for (a, length), q in out.items())


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(((a, length, q) for a, length, q in brute_runs(words)), key=lambda r: (r[0], r[2]))
    best = (None,) * 4
    if runs:
        top = max(length / q for _, length, q in runs)
        a, length, q = min((r for r in runs if r[1] / r[2] == top), key=lambda r: (r[0], r[2]))
        best = (a, length, q, 1000 * length // q)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def longest_lyndon(s):
    return [max(k for k in range(1, len(s) - i + 1) if all(s[i : i + k] < s[i + d : i + k] for d in range(1, k))) for i in range(len(s))]


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_lyndon_lengths_under_both_orders(letters):
    rng = random.Random(letters)
    for _ in range(400):
        s = [rng.randrange(letters) for _ in range(rng.randint(1, 14))]
        assert lyndon_lengths(np.array(s)).tolist() == longest_lyndon(s)
        assert lyndon_lengths(-np.array(s)).tolist() == longest_lyndon([-x for x in s])
    assert lyndon_lengths(np.zeros(0, dtype=int)).tolist() == []


@pytest.mark.parametrize(("least", "exponent"), [(2, 2), (5, 3), (24, 3)])
def test_runs(least, exponent):
    rng = random.Random(least)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 60))]
        s += (s[: rng.randint(1, 8)] * 20)[: rng.randint(1, 60)] + s[:9]
        assert list(map(tuple, runs_of(np.array(s), least, exponent).tolist())) == brute_runs(s, least, exponent)


def test_all_runs_lie_in_candidate_stretches():
    rng = random.Random(9)
    for _ in range(300):
        s = []
        while len(s) < 300:
            part = [rng.randrange(rng.choice([2, 30])) for _ in range(rng.randint(1, 40))]
            s += part * rng.choice([1, 1, 3, 5])
        spans = list(zip(*candidate_stretches(np.array(s), 24), strict=True))
        for a, length, _ in brute_runs(s):
            assert any(x <= a and a + length <= y for x, y in spans)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(60)] + ["é", "x,1"]
    rows = [(None, None), (None, "a b " * 40), (1, None), (2, ""), (3, " \n\t"), (4, "same " * 24), (5, "same " * 23), (6, "a b c d e f g h " * 3), (6, "a b c d e f g h " * 3), (7, "x" * 1_000_000)]
    for i in range(100, 220):
        words = []
        for _ in range(rng.randint(1, 12)):
            words += [rng.choice(vocab) for _ in range(rng.randint(1, 30))] * rng.choice([1, 1, 1, 3, 4, 12])
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, length string").repartition(3)
    for config in (Config(block_words=100), Config()):
        assert sorted(map(tuple, periodic_runs(docs, config).collect()), key=repr) == sorted((brute_row(*r) for r in rows), key=repr)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    """Two hundred thousand words of one period, and one of many words without a run."""
    docs = spark.createDataFrame([(1, "a b c " * 70_000), (2, " ".join(map(str, range(200_000))))], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs(docs).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period, got[1].exponent_milli) == (1, 0, 210_000, 3, 70_000_000)
    assert (got[2].n_runs, got[2].start) == (0, None)


def test_settings_that_the_candidates_do_not_cover(spark):
    with pytest.raises(ValueError, match="24 words"):
        periodic_runs(spark.createDataFrame([], "doc_id long, text string"), Config(least=10))
