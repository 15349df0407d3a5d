import random

import pytest

from lakeloom.operators import follow_ups as f
from lakeloom.operators.follow_ups import completed, follow_ups

REPLY = ("assistant", "The price of the Red Boxer Combo is 5.")


@pytest.mark.parametrize(
    ("question", "history", "want"),
    [
        ("black cotton shirt", [REPLY], ("complete", "black cotton shirt")),
        ("price?", [], ("first", "price?")),
        ("price?", [REPLY], ("subject", "Red Boxer Combo price?")),
        ("how much is it", [("assistant", "Blue Denim Jacket comes in two sizes.")], ("subject", "Blue Denim Jacket how much is it")),
        ("এটির material cotton", [REPLY], ("subject", "Red Boxer Combo এটির material cotton")),  # it points back
        ("where?", [("user", "the price of a shirt")], ("place", "store location where")),
        ("mirpur?", [REPLY, ("user", "shop in Dhaka")], ("place", "store locations mirpur")),
        ("mirpur?", [("user", "MIRPUR?"), ("user", "shirt price")], ("place", "store location mirpur")),  # the same question again doesn't count
        ("price?", [("assistant", "It is here."), ("user", "price?"), ("user", "a long question here")], ("question", "a long question here price?")),
        ("price?", [("assistant", "Unfortunately is not."), ("user", "hm")], ("nothing", "price?")),
        ("price?", [("assistant", ""), ("user", "boxer")], ("nothing", "price?")),
        ("", [REPLY], ("subject", "Red Boxer Combo ")),
    ],
)
def test_cases(question, history, want):
    assert completed(question, history) == want


@pytest.mark.parametrize("piece", [1000, 60])
def test_rows_against_a_walk_over_each_conversation(spark, monkeypatch, piece):
    monkeypatch.setattr(f, "PIECE", piece)
    rng = random.Random(piece)
    texts = ["price?", "where is it?", "a long question about shirts", REPLY[1], "Blue Denim Jacket has two.", "It is here.", None, "ok"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(texts)) for c in (1, 2, None) for t in range(rng.choice([5, 200]))]
    rows += [(3, t, "user", f"q {t}") for t in (0, 49, 50, 51, 100, 151, 5000)] + [(3, 100, "assistant", REPLY[1]), (4, None, "user", "price?"), (4, 1, "assistant", REPLY[1])]
    want = []
    for c, t, role, text in rows:
        if role == "user":
            past = sorted((x for x in rows if x[0] == c and x[1] is not None and t is not None and t - f.HISTORY <= x[1] < t), key=lambda x: (x[1], x[2] or "", x[3] or ""))
            want.append((c, t, *completed(text or "", [(r or "", m or "") for _, _, r, m in reversed(past)])))
    got = follow_ups(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert follow_ups(got.sparkSession.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
