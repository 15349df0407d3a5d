import math
from collections import Counter

import numpy as np

from lakeloom.llm.language_id import Config, _estimate, identify, letters, train
from lakeloom.llm.queries import op8_kneser_ney_language

SF = "/root/testdata/sf0.01"


def brute_kn(texts, order, discount):
    """Interpolated Kneser-Ney straight from its definition, over Counters."""
    seqs = []
    for t in texts:
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        seqs.append("\0" * (order - 1) + "".join(c for i, c in enumerate(s) if c != " " or (i and s[i - 1] != " ")))
    full = Counter(s[i - order + 1 : i + 1] for s in seqs for i in range(order - 1, len(s)))
    counts = {order: full}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    base = 1 / (len(counts[1]) + 1)

    def p(context, c, k):
        if k == 0:
            return base
        ctx = context[len(context) - k + 1 :] if k > 1 else ""
        total = sum(n for g, n in counts[k].items() if g[:-1] == ctx)
        kinds = sum(1 for g in counts[k] if g[:-1] == ctx)
        if not total:
            return p(context, c, k - 1)
        return max(counts[k][ctx + c] - discount, 0) / total + discount * kinds / total * p(context, c, k - 1)

    return p


def test_probabilities_against_the_definition():
    from lakeloom.llm.language_id import Model

    texts = ["the cat, the  hat!", "a theme", "Et tu"]
    full = Counter()
    code, _ = letters(texts, 2)
    for i in np.flatnonzero(code != 0):
        full[tuple(code[i - 2 : i + 1].tolist())] += 1
    keys = sorted(full)
    grams, contexts, uniform = _estimate(np.array(keys, dtype=np.uint32), np.array([full[k] for k in keys], float), 3, 0.75)
    model = Model(["x"], 3, [grams], [contexts], [uniform])
    brute = brute_kn(texts, 3, 0.75)
    for gram in ("\0\0t", "the", "he ", "xqz", "h t", "eme", "thz"):
        got = model.log_prob(np.array([[ord(c) for c in gram]], dtype=np.uint32))[0, 0]
        assert math.isclose(2**got, brute(gram[:2], gram[2], 3), rel_tol=1e-9), gram
    total = sum(2 ** model.log_prob(np.array([[ord("t"), ord("h"), c]], dtype=np.uint32))[0, 0] for c in {k[-1] for k in keys})
    assert 0.9 < total <= 1


def test_letters():
    code, text = letters(["a  b", "", None, "É!?x", "  "], 2)
    got = ["".join(map(chr, code[text == i])).strip("\0") for i in range(5)]
    assert got == ["a b", "", "", "é x", ""]


def test_held_out_accuracy(spark):
    out = op8_kneser_ney_language(spark, SF)
    rows = out.where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 100 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95


def test_edges(spark):
    rows = [(i, "the cat sat on the mat and then" if i % 2 else "der hund und die katze sind hier", "en" if i % 2 else "de") for i in range(20)] + [(50, "nichts", None), (51, None, "en")]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, None, "x"), (2, "123 --", "x"), (3, "", "x"), (None, "die katze", "x"), (4, "the cat sat on the mat and then " * 5_000, "x"), (5, "жжж щщщ ыыы эээ", "x"), (4, "the cat sat on the mat", "x")], "doc_id long, text string, score string")
    got = identify(docs, model).collect()
    assert len(got) == 7
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"} and {r.score for r in got if r.doc_id in (1, 2, 3)} == {0.0}
    assert [r.lang_pred for r in got if r.doc_id is None] == ["de"] and {r.lang_pred for r in got if r.doc_id == 4} == {"en"}
    assert [r.rejected for r in got if r.doc_id == 5] == [True] and not any(r.rejected for r in got if r.doc_id == 4)
    none = train(spark.createDataFrame([], "doc_id long, text string, lang string"), Config())
    assert {r.lang_pred for r in identify(docs, none).collect()} == {"und"}
    assert identify(docs.limit(0), model).count() == 0


def test_every_gram_counts(spark):
    """A language with more than 300,000 distinct 4-grams keeps all of them."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 1_000))) for _ in range(340)]
    model = train(spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    grams = {("\0\0\0" + t)[i : i + 4] for t in texts for i in range(len(t))}
    assert len(grams) > 300_000 and len(model.grams[0][3][0]) == len(grams)


def test_tables_give_what_arrays_give(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(None, "die katze", "de"), (-1, None, "en"), (-2, "12 --", "fr"), (-3, "жжж щщщ", None)], docs.schema)
    docs = docs.unionByName(odd)
    found = []
    for config in (Config(), Config(broadcast_grams=0, hot_grams=0), Config(broadcast_grams=0, hot_grams=500)):
        model = train(docs, config)
        assert type(model).__name__ == ("Tables" if config.broadcast_grams == 0 else "Model")
        rows = identify(docs, model, config).collect()
        found.append((model.limits, sorted((-99 if r.doc_id is None else r.doc_id, r.lang_pred, round(r.score, 9), r.rejected) for r in rows)))
    for limits, rows in found[1:]:
        assert np.allclose(limits, found[0][0]) and rows == found[0][1]


def test_limits_cover_every_language(spark):
    """A language with few rows beside thousands of others has a limit of its own."""
    rows = [(i, f"the cat sat on the mat and then number {i}", "en") for i in range(20_000)] + [(-1, "der hund und die katze sind hier", "de")]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"] and np.isfinite(model.limits).all()


def test_emoji_are_no_letters(spark):
    code, _ = letters(["\U0001f600a\U00020000\U0001f680"], 1)
    assert "".join(map(chr, code)).strip("\0 ") == "a\U00020000"
    model = train(spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der hund ist hier", "de")], "doc_id long, text string, lang string"))
    got = identify(spark.createDataFrame([(1, "\U0001f600\U0001f680"), (2, "\U0001f600 12, \U0001f680!")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in got] == [("und", 0.0, True)] * 2
