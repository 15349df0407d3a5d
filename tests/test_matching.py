import random
import re

import pytest

from lakeloom.operators.matching import first_matches


def brute(entities, results, above):
    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    out = []
    for i, url, title in entities:
        hit = (i, None, None)
        for position, other_url, other_title in sorted(results):
            same = (url or "").rstrip("/") == (other_url or "").rstrip("/")
            a, b = words(title), words(other_title)
            if same or (a and b and len(a & b) / len(a | b) > above):
                hit = (i, position, same)
                break
        out.append(hit)
    return sorted(out, key=repr)


def run(spark, entities, results, above=0.85):
    found = first_matches(spark.createDataFrame(entities, "id long, url string, title string").repartition(3), spark.createDataFrame(results, "position long, url string, title string").repartition(2), above)
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("above", [0.85, 0.5, 0.75])
def test_against_brute_force(spark, above):
    rng = random.Random(int(100 * above))
    vocab = ["Red", "blue", "Shirt", "cap", "Größe", "x1", "new", "old", "wool", "men"]
    title = lambda: rng.choice(["", None, " - "]) if rng.random() < 0.1 else ", ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12)))
    url = lambda: rng.choice([None, "", "/"]) if rng.random() < 0.1 else f"http://s/{rng.randint(0, 150)}" + "/" * rng.randint(0, 2)
    entities = [(rng.randint(0, 100), url(), title()) for _ in range(150)] + [(None, "u", "Red cap")]
    results = [(p, url(), title()) for p in rng.sample(range(1000), 60)]
    assert run(spark, entities, results, above) == brute(entities, results, above)


def test_edges(spark):
    entities = [(1, "http://s/a/", "one two three four five six seven"), (2, "http://s/none", "one two three four five six seven"), (2, "http://s/none", "one two three four five six seven"), (3, "http://s/b", None), (4, "http://s/none", "ONE two three four five six SEVEN eight"), (5, None, "x")]
    # Position 3 has the title, 5 the address: the smaller position counts.  Seven of eight words are above 0.85.
    results = [(5, "http://s/a", ""), (3, "http://s/q", "seven six five four three two one"), (9, "http://s/b///", None)]
    assert run(spark, entities, results) == brute(entities, results, 0.85) == sorted([(1, 3, False), (2, 3, False), (2, 3, False), (3, 9, True), (4, 3, False), (5, None, None)], key=repr)
    assert run(spark, entities, []) == brute(entities, [], 0.85)
    assert run(spark, [], results) == []


def test_pairs_do_not_grow_with_copies(spark):
    """A thousand entities and results of one title meet as one pair of sets."""
    entities, results = [(i, "", "a b c d") for i in range(1000)], [(p, f"u{p}", "d c b a") for p in range(1000)]
    assert {(p, by) for _, p, by in run(spark, entities, results)} == {(0, False)}
