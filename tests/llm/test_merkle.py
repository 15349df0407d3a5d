import hashlib
import random
import zlib

import pytest

from lakeloom.llm.merkle import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, parent int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(levels, idx, digest, proof):
    """Fold a digest up the levels of one tree."""
    for level in levels[:-1]:
        run = level[idx // 8 * 8 : idx // 8 * 8 + 8]
        proof += [d for k, d in enumerate(run) if k != idx % 8]
        run[idx % 8] = digest
        idx, digest = idx // 8, H(*run)
    return digest


def tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in own[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            given, proof = r, []
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                given = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            folded = climb(top, k, climb(trees[x], i, leaf(given), proof), proof)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], H(*proof), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def corpus(n, langs, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", None, "é"]), rng.choice(langs), rng.choice([None, i]), rng.choice([None, "", "Abc", "xyz", "ÄB\n" * rng.randint(1, 9)])) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize(("n", "langs"), [(1, ["en"]), (700, ["en"]), (300, [None, "", "en", "fr", "Z", "é", "a", "b", "c", "d", "e"]), (90, [f"l{k}" for k in range(70)])])
def test_against_brute_force(spark, n, langs):
    rows = corpus(n, langs, n)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    got = manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_edges(spark):
    """Null and repeated ids, equal rows, a very long text, an empty table; the session's settings stay."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    rows = [(None, None, None, None, None), (None, "s", None, 1, "B"), (3, "s", "en", 1, "A" * 2_000_000), (3, "s", "en", 1, "A" * 2_000_000), (3, "s", "en", 1, "b"), (7, "s", "en", 1, "")]
    docs = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    assert sorted(map(tuple, manifest(docs).collect()), key=repr) == brute(rows)
    assert manifest(docs.limit(0)).count() == 0
    assert spark.conf.get(key, None) == before
