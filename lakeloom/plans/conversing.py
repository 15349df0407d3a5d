"""Follow-up questions, and documents as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.follow_ups import EMPTY_WORDS, HISTORY, NO_SUBJECTS, PLACES, SUBJECTS, follow_ups
from lakeloom.plans.registry import query, table
from lakeloom.plans.texts import s
from lakeloom.storage import scratch_path
from lakeloom.streaming.ingest import actions, ingest_batch, known_state

_SHORT = """CASE WHEN role = 'user' AND (conv_id + turn) % 5 = 0 THEN 'price?' WHEN role = 'user' AND (conv_id + turn) % 5 = 1 THEN split_part(text, ' ', 1) || ' cost' WHEN role = 'user' AND (conv_id + turn) % 5 = 2 THEN 'where is it?'
WHEN role = 'assistant' AND conv_id % 3 = 0 THEN 'The price of Red' || split_part(text, ' ', 1) || ' Shirt is 5.' WHEN role = 'assistant' AND conv_id % 3 = 1 THEN 'It is here.' ELSE text END"""


def short_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text): the bundled messages are long, so three of five questions are made short, and two of three replies name something."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr(_SHORT).alias("text"))


def _in_list(x: str, words) -> str:
    return f"list_has_any({x}, [{', '.join(map(s, sorted(words)))}])"


# DuckDB's word characters are ASCII, those of Python are letters and digits of all scripts.
_NAMES = [f"trim(regexp_extract(reply, {s(p.replace(chr(92) + 'w', '_' + chr(92) + 'p{L}' + chr(92) + 'p{N}'))}, 1))" for p in SUBJECTS]
_SUBJECT_SQL = "CASE " + " ".join(f"WHEN length({x}) > 3 AND NOT lower({x}) IN ({', '.join(map(s, sorted(NO_SUBJECTS)))}) THEN {x}" for x in _NAMES) + " END"


@query(f"""WITH m AS (SELECT conv_id, turn, role, {_SHORT} AS text FROM conversations), q AS (SELECT conv_id, turn, text, trim(rtrim(trim(text), '?')) AS bare FROM m WHERE role = 'user'),
p AS (SELECT q.conv_id, q.turn, m.turn AS back, m.role, m.text AS said, m.role = 'user' AND lower(m.text) <> lower(q.text) AS other, len(regexp_split_to_array(trim(m.text), '\\s+')) > len(regexp_split_to_array(trim(q.text), '\\s+')) AS longer
FROM q JOIN m ON m.conv_id = q.conv_id AND m.turn < q.turn AND m.turn >= q.turn - {HISTORY}),
h AS (SELECT conv_id, turn, arg_max(said, back) FILTER (WHERE role = 'assistant') AS reply, arg_max(said, back) FILTER (WHERE other) AS earlier, arg_max(said, back) FILTER (WHERE other AND longer) AS question FROM p GROUP BY 1, 2),
a AS (SELECT q.*, h.conv_id IS NOT NULL AS told, reply, earlier, question, len(list_filter(regexp_extract_all(lower(bare), '[a-zA-Z]+'), lambda w: length(w) > 2 AND NOT list_contains([{", ".join(map(s, sorted(EMPTY_WORDS)))}], w))) > 1 AS complete FROM q LEFT JOIN h USING (conv_id, turn)),
b AS (SELECT *, {_SUBJECT_SQL} AS subject FROM a), c AS (SELECT *, CASE WHEN complete THEN 'complete' WHEN NOT told THEN 'first' WHEN {_in_list("regexp_extract_all(lower(bare), '[a-z]+')", PLACES)} THEN 'place' WHEN subject IS NOT NULL THEN 'subject' WHEN question IS NOT NULL THEN 'question' ELSE 'nothing' END AS rule FROM b)
SELECT conv_id, turn, rule, md5(CASE rule WHEN 'place' THEN 'store location' || CASE WHEN earlier IS NOT NULL AND {_in_list("regexp_extract_all(lower(earlier), '[a-z]+')", PLACES)} THEN 's ' ELSE ' ' END || bare WHEN 'subject' THEN subject || ' ' || text WHEN 'question' THEN question || ' ' || text ELSE text END) AS digest FROM c""")
def completed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of the user, completed from its conversation."""
    return follow_ups(short_messages(spark, sf_dir)).select("conv_id", "turn", "rule", F.md5("completed").alias("digest"))


@query("""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS source, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS action, sha256(text) AS hash, CAST(CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS version FROM n""")
def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second batch does with every document after a first one had two thirds of them, and the version that is stored; the second batch runs twice."""
    folder = scratch_path(spark, "ingest")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("source"), F.lit(1).alias("at"), "text")
    ingest_batch(docs.where("doc_id % 3 <> 0"), 0, folder)
    now = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    for _ in range(2):
        ingest_batch(now, 1, folder)
    return actions(spark, folder).where("number = 1").select("source", "action").join(known_state(spark, folder), "source").select("source", "action", "hash", F.col("number").alias("version"))
