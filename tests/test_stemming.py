import math
from collections import Counter

import pytest

from lakeloom.operators.search import bm25
from lakeloom.operators.stemming import stem, stemmed, stems

# Pairs from the published description of the stemmer.
PUBLISHED = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid
consolidating consolid consoling consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee
knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skies sky dying die gently gentl news news inning inning succeed succeed generate generat communism communism ties tie cries cri gas gas this this gaps gap kiwis kiwi hopping hop hoped hope hoping hope
luxuriated luxuri bed bed shred shred cry cri by by say say happy happi beautifully beauti sensational sensat rational ration replacement replac adoption adopt controlling control roll roll"""


def test_published_examples():
    words = PUBLISHED.split()
    wrong = {w: (stem(w), s) for w, s in zip(words[::2], words[1::2], strict=True) if stem(w) != s}
    assert not wrong


def test_stop_words_and_characters():
    assert stems("The knights, who WERE knocking 42 times!") == ["knight", "knock", "42", "time"]
    assert stems(None) == stems("") == stems("the of and") == []


@pytest.mark.parametrize("first", [None, 2])
def test_search_on_stems_against_brute_force(spark, first):
    docs = {1: "Knights were knocking.", 2: "a knight knocks; knights knock", 3: "consistently knitted", 4: "", 5: None, 6: "the of", 7: "knight's consistency knocked knock", 8: "Knights were knocking."}
    asked = {1: "the knight who knocked", 2: "consistent knitting", 3: "of the", 4: None, 5: "knocker", 6: "knock knocked knights consist"}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = bm25(stemmed(spark.createDataFrame(list(asked.items()), "query_id long, text string"), "query_id", "text", first), stemmed(rows, "doc_id", "text"), 3, every_term=True)
    held = {d: stems(t) for d, t in docs.items()}
    mean = sum(map(len, held.values())) / len(held)
    want = []
    for q, text in asked.items():
        terms = list(dict.fromkeys(stems(text)))[:first]
        scored = []
        for d, words in held.items():
            tf = Counter(words)
            if terms and all(tf[t] for t in terms):
                df = {t: sum(t in w for w in held.values()) for t in terms}
                scored.append((-round(sum(math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(words) / mean)) for t in terms), 5), d))
        want += [(q, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:3], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(q == 1 for q, *_ in want)
