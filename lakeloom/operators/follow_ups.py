"""Short follow-up questions, completed from the conversation so far."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that don't say what a question is about, and what points back or to a place.
EMPTY_WORDS = frozenset("how much what is the are does do price cost tell me about show its a an of for and or in on at".split())
POINTING_BACK = ("এটির", "এটা", "এটি", "ওটার", "ওটা", "সেটার", "সেটি", "সেটা", "এগুলো")
PLACES = frozenset("store location shop branch outlet address where dhaka chittagong ctg sylhet narayanganj mirpur gulshan dhanmondi bashundhara jumuna wari airport".split())
SUBJECTS = (
    r"(?:price|cost|material|color|colour|size|description|availability|stock|variant|detail)s?\s+of\s+(?:the\s+)?([A-Z][\w\s]{3,50}?)\s+(?:is|are|was|were)",
    r"^(?:The\s+)?([A-Z][\w\s]{3,50}?)\s+(?:is|are|features|comes|has|costs|retails)",
)
NO_SUBJECTS = frozenset(("the", "it", "this", "that", "there", "unfortunately", "i", "materials used", "material", "price", "color", "size", "no information", "turaag active"))
#: Turns that are looked back at.
HISTORY = 50
# End of the fixed values.

_SUBJECTS = [re.compile(p) for p in SUBJECTS]
_LETTERS, _LOWER = re.compile("[a-zA-Z]+"), re.compile("[a-z]+")
#: Turns of one conversation that are folded in one piece; a piece starts with the last HISTORY turns of the one before.
PIECE = 1000


def _places(text: str) -> bool:
    return not PLACES.isdisjoint(_LOWER.findall(text.lower()))


def subject_of(reply: str) -> str | None:
    """What an assistant's reply speaks of, by its first pattern that gives a name."""
    for p in _SUBJECTS:
        if (m := p.search(reply)) and (name := m[1].strip()) and name.lower() not in NO_SUBJECTS and len(name) > 3:
            return name
    return None


def completed(question: str, history: Iterable[tuple[str, str]]) -> tuple[str, str]:
    """(rule, question): a question with what it lacks, from (role, text) of the turns before, newest first.

    A question of two words that say something stands by itself, unless it points
    back.  A question about a place is never given a product; others get the
    subject of the last reply, else the last longer question.
    """
    bare = question.strip().rstrip("?").strip()
    content = [w for w in _LETTERS.findall(bare.lower()) if len(w) > 2 and w not in EMPTY_WORDS]
    if len(content) > 1 and not any(p in question for p in POINTING_BACK):
        return "complete", question
    history = list(history)
    if not history:
        return "first", question
    others = [text for role, text in history if role == "user" and text.lower() != question.lower()]
    if _places(bare):
        again = bool(others) and _places(others[0])
        return "place", f"store location{'s' if again else ''} {bare}"
    reply = next((text for role, text in history if role == "assistant"), None)
    if reply and (subject := subject_of(reply)):
        return "subject", f"{subject} {question}"
    size = len(question.split())
    longer = next((text for text in others if len(text.split()) > size), None)
    return ("question", f"{longer} {question}") if longer else ("nothing", question)


def follow_ups(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, rule, completed) of the user's rows of (conv_id, turn, role, text).

    The history of a row is the rows of its conversation whose turn is one of the
    HISTORY numbers below its own, those of equal turn in the order of role and
    text.  Conversations are cut in pieces of PIECE turns, so a very long one is
    many keys.  A null text is an empty one; a null conversation is one
    conversation; rows without a turn have no history and are none.
    """
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    piece = F.floor(F.col("turn") / PIECE)
    seen_again = F.when(F.pmod("turn", F.lit(PIECE)) >= PIECE - HISTORY, F.array(piece, piece + 1)).otherwise(F.array(piece))
    dealt = rows.withColumn("home", piece).withColumn("piece", F.explode(seen_again))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, past, same = None, deque(), []
        for batch in batches:
            out = []
            for conv, turn, role, text, home, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, piece) != now:
                    now, past, same = (conv, piece), deque(), []
                if same and same[0][0] != turn:  # rows of one turn don't see each other
                    past.extendleft(same)
                    same = []
                while past and (turn is None or past[-1][0] < turn - HISTORY):
                    past.pop()
                if role == "user" and home == piece:
                    out.append((conv, turn, *completed(text, [(r, t) for _, r, t in past])))
                if turn is not None:
                    same.append((turn, role, text))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "turn", "rule", "completed"])

    some = dealt.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", "home", "piece")
    timeless = rows.where("turn IS NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", F.lit(0).cast("long").alias("home"), F.lit(0).cast("long").alias("piece"))
    told = some.where("turn IS NOT NULL").repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "turn", "role", "text")
    schema = "conv_id long, turn long, rule string, completed string"
    return told.mapInArrow(run, schema).unionByName(timeless.mapInArrow(run, schema))
