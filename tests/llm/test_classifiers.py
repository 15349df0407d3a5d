import pytest
from pyspark.sql import functions as F

from lakeloom.llm import subword_classifier, toxicity
from lakeloom.llm.common import fold
from lakeloom.llm.queries import op2_subword_quality, op10_toxic_lexicon

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "label"), [(op2_subword_quality, "quality"), (op10_toxic_lexicon, "toxic")])
def test_held_out_accuracy(spark, query, label):
    out = query(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = out.where("held_out").join(labels, "doc_id").select("predicted", label, "score").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r[label] for r in rows) / len(rows) >= 0.95
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def edge_docs(spark):
    return spark.createDataFrame([(1, "", "x"), (2, None, "x"), (None, "some words", "x"), (3, "dup", "x"), (3, "dup", "x"), (4, "long " * 50_000, "x")], "doc_id long, text string, score string")


def test_quality_edges(spark):
    docs = edge_docs(spark)
    rows = [(i, ("good text here " if i % 2 else "### $$$ %%% ") * 5, i % 2) for i in range(40)] + [(99, "x", None)]
    known = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = subword_classifier.train(known.drop("label"), known, subword_classifier.Config(buckets=1 << 12))
    got = subword_classifier.score(docs, model, subword_classifier.Config(buckets=1 << 12)).collect()
    assert len(got) == 6
    assert {r.score for r in got if r.doc_id in (1, 2)} == {model.prior[1]}
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    none = subword_classifier.train(docs, known.limit(0))
    assert {r.score for r in subword_classifier.score(docs, none).collect()} == {0.5}
    assert subword_classifier.score(docs.limit(0), model).count() == 0


def test_quality_features_by_hand():
    import pyarrow as pa

    config = subword_classifier.Config(buckets=1 << 30, sizes=(3,))
    bucket, doc = subword_classifier.features(pa.array(["ab ab", "xx", "", None, "ab"]), config)
    by = {d: sorted(bucket[doc == d].tolist()) for d in range(5)}
    assert len(by[0]) == 2 + 1 + 2 * 2 and len(by[1]) == 1 + 2 and not by[2] and not by[3]
    assert set(by[4]) < set(by[0])


def test_folding():
    fold = toxicity.fold_text
    assert fold("L0SER!") == fold("lоser") == fold("loser,") == " ioser "
    assert fold("st!nk p@thet1c") == fold("stink pathetic")
    assert fold("Été​ naïve") == fold("ete naive")


def test_toxic_edges(spark):
    rows = [(i, f"w{i} is a {'stupid moron' if i % 3 == 0 else 'fine person'} in place {i}", int(i % 3 == 0)) for i in range(90)]
    known = spark.createDataFrame(rows, "doc_id long, text string, label int")
    lexicon = toxicity.learn(known.drop("label"), known)
    assert any("stup" in k for k in lexicon.weights)
    docs = spark.createDataFrame([(1, "You 5tup1d one"), (2, ""), (3, None), (None, "a fine place"), (4, "fine " * 30_000 + "stupid moron")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert got[1] > 0.5 and got[4] > 0.5 and got[2] < 0.5 and got[3] == got[2] == got[None]
    phrase = toxicity.Lexicon({" trash ": 5.0})
    automaton = toxicity.matcher(phrase)
    assert toxicity.weigh("put it in the trash can", automaton) == 0 < toxicity.weigh("you trash", automaton)
    empty = toxicity.learn(docs, known.limit(0))
    assert not empty.weights and toxicity.score(docs, empty).count() == 5


def test_weights_against_brute_force():
    """The automaton's sum against a scan of every word and phrase."""
    import math
    import random

    rng = random.Random(3)
    lexicon = toxicity.Lexicon({" stup": 4.0, " stupid ": 5.0, " moron ": 3.0, " trash ": 2.0, " ioser ": 6.0})
    automaton = toxicity.matcher(lexicon)
    phrases = [toxicity.fold_text(p).split() for p in lexicon.exceptions]
    vocab = ["stupid", "5tup1d", "stupor", "st", "moron", "morons", "tr@sh", "can", "bin", "L0SER", "fine", "é", "clown", "fish", "trash-can", "", "x" * 300]
    for _ in range(500):
        text = " ".join(rng.choices(vocab, k=rng.randint(0, 400)))
        words = toxicity.fold_text(text).split()
        safe = {i + k for p in phrases for i in range(len(words)) if words[i : i + len(p)] == p for k in range(len(p))}
        total = 0.0
        for i, w in enumerate(words):
            total += 0 if i in safe else max([v for p, v in lexicon.weights.items() if (w == p.strip() if p.endswith(" ") else w.startswith(p[1:]))], default=0.0)
        spaces = toxicity.fold_text(text).count(" ")
        assert abs(toxicity.weigh(text, automaton) - total / (1 + math.log1p(spaces / 100) / 4)) < 1e-9


def test_learned_lexicon(spark):
    """Texts that share a passage keep their labels, near copies count once, and clean phrases become exceptions."""
    shared = "this same opening passage begins every single one of the texts"
    rows = [(i, f"{shared} and then a {'stupid' if i % 2 else 'gentle'} thing number{i} happens to person{i} near river{i} on day{i} with tool{i}", i % 2) for i in range(80)]
    rows += [(100 + i, "one copied toxic text with the word parrot in it " * 6, 1) for i in range(30)]
    rows += [(200 + i, f"a stupid error message{i} in file{i} of job{i}", 0) for i in range(8)]
    known = spark.createDataFrame(rows, "doc_id long, text string, label int")
    lexicon = toxicity.learn(known.drop("label"), known)
    assert any("stup" in k for k in lexicon.weights) and not any("parr" in k for k in lexicon.weights)
    assert "stupid error" in lexicon.exceptions and "stupid thing" not in lexicon.exceptions
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, "a stupid error"), (2, "a stupid thing")], "doc_id long, text string"), lexicon).collect()}
    assert got[1] < 0.5 < got[2]


def brute_features(text, config):
    """The hashed features of one text, word by word, as a sorted list of names."""
    import re

    out = []
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    for a, b in zip(words, words[1:], strict=False):
        out.append(("pair", "same") if a == b else ("pair", a, b))
    for w in words:
        out.append(("word", w))
        marked = [-1, *w, -2]
        for n in config.sizes:
            out += [("gram", *[-1 if x == -2 else x for x in marked[i : i + n]]) for i in range(len(marked) - n + 1)]
    return out


def test_quality_against_brute_force(spark):
    """Features by name, and scores by the definition: softmax of the mean vector times the output layer."""
    import numpy as np
    import pyarrow as pa

    config = subword_classifier.Config(buckets=1 << 26, sizes=(3, 4), epochs=2)
    small = subword_classifier.Config(buckets=1 << 12, epochs=2)
    texts = ["the cat sat on the mat", "a a a b", "Ünïcode wörds", "x", "", None, "tab\tsep\x0bvt\nline", "end of the cat " * 50]
    bucket, doc = subword_classifier.features(pa.array(texts), config)
    ids = {}
    for d, t in enumerate(texts):
        want = brute_features(t or "", config)
        got = bucket[doc == d].tolist()
        assert len(got) == len(want)
        # One name has one bucket and the other way round: equal multisets of counts, joined over all texts.
        for name in want:
            ids.setdefault(name, set())
        counts = {}
        for b in got:
            counts[b] = counts.get(b, 0) + 1
        names = {}
        for n in want:
            names[n] = names.get(n, 0) + 1
        assert sorted(counts.values()) == sorted(names.values())
    assert len(set(bucket.tolist())) == len(ids)
    rows = [(i, ("good text here " if i % 2 else "### bad %%% ") * (1 + i % 4) + f"w{i}", i % 2) for i in range(40)]
    known = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = subword_classifier.train(known.drop("label"), known, small)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in subword_classifier.score(docs, model, small).collect()}
    for d, t in enumerate(texts):
        b, _ = subword_classifier.features(pa.array([t or ""]), small)
        if not len(b):
            assert got[d] == model.prior[1]
            continue
        z = model.vectors[b].astype(np.float64).mean(axis=0) @ model.output.astype(np.float64)
        assert abs(got[d] - np.exp(z[1]) / np.exp(z).sum()) < 1e-5


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", fold("id", 3).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in rows)
    assert spark.range(1).select(fold(F.lit(None), 3).alias("f")).first().f is None


def test_the_driver_gets_features_packed(spark, monkeypatch):
    """Of the labelled texts' features the driver gets less than half of 8 bytes each."""
    import numpy as np
    import pyarrow as pa

    config = subword_classifier.Config(epochs=1)
    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{i * 7919 * k % 100_003}" for k in range(400)), i % 2) for i in range(60)]
    known = spark.createDataFrame(rows, "doc_id long, text string, label int")
    sent, frame = [], type(known)
    whole = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: sent.append(whole(self)) or sent[-1])
    model = subword_classifier.train(known.drop("label"), known.drop("text"), config)
    n = sum(len(np.unique(subword_classifier.features(pa.array([t]), config)[0])) for _, t, _ in rows)
    assert sum(t.nbytes for t in sent) < 4 * n
    got = subword_classifier.score(known, model, config).collect()
    assert sum((r.score >= 0.5) == bool(r.doc_id % 2) for r in got) >= 58
    for kinds in ([], [0], [3, 9, (1 << 30) - 1]):
        buckets, counts = subword_classifier.open_features(subword_classifier.pack_features(np.array(kinds, dtype=np.int32), np.arange(len(kinds)) + 70_000))
        assert buckets.tolist() == kinds and counts.tolist() == [70_000 + i for i in range(len(kinds))]
