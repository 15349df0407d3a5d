import random

from lakeloom.operators.expansion import ALWAYS, SHORT, expanded_chunks
from lakeloom.sources.files import nested_sitemap_addresses

COLUMNS = "id long, source string, chunk_index int, kind string, content string"


def brute(rows, window, force):
    out = []
    for i, source, at, kind, content in rows:
        own, grown = content or "", content or ""
        if source and at is not None and (force or len(own) < SHORT or (kind or "text") in ALWAYS):
            near = sorted((r for r in rows if r[1] == source and r[2] is not None and max(0, at - window) <= r[2] <= at + window), key=lambda r: (r[2], r[0]))
            grown = "\n\n".join(r[4] or "" for r in near)
        out.append((i, grown, True) if len(grown) > len(own) else (i, own, False))
    return sorted(out)


def test_expansion_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "", None]), rng.choice([None, *range(12)]), rng.choice([None, "text", "faq", "table", "product"]), rng.choice([None, "", "short", "x" * SHORT, "y" * (SHORT - 1)])) for i in range(80)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    for window, force in ((1, False), (2, False), (1, True)):
        assert sorted(map(tuple, expanded_chunks(df, window, force).collect())) == brute(rows, window, force)
    assert expanded_chunks(df.limit(0)).count() == 0


def test_nested_sitemaps(spark):
    loc = lambda *names: "".join(f"<url><LOC> {n} </LOC></url>" for n in names)
    files = {"r.xml": loc("p1", "a.xml", "b.xml", "gone.xml"), "a.xml": loc("p2", "p1", "c.xml", "r.xml"), "b.xml": loc("c.xml", ""), "c.xml": loc("p3", "d.xml", "a.xml"), "d.xml": loc("p4"), "other.xml": loc("q1")}
    df = spark.createDataFrame(list(files.items()), "source string, text string")
    run = lambda depth, *roots: {tuple(r) for r in nested_sitemap_addresses(df, spark.createDataFrame([(r,) for r in roots], "root string"), depth).collect()}
    assert run(2, "r.xml", "other.xml") == {("r.xml", "p1"), ("r.xml", "p2"), ("r.xml", "p3"), ("other.xml", "q1")}
    assert run(0, "r.xml") == {("r.xml", "p1")}
    assert run(3, "r.xml") == {("r.xml", p) for p in ("p1", "p2", "p3", "p4")}
    assert run(2, "none.xml") == set()
