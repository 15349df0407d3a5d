"""Record texts of products and their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.records import BLOCKS, CURRENCY, LINES, NUMBER, PRICE_LINE, block_pattern, line_pattern, record_fields
from lakeloom.plans.registry import query, table
from lakeloom.plans.texts import s

#: A record text from a document's columns, in the syntax that both engines share; each third, fourth or fifth row lacks something.
_CONTENT = """concat_ws(chr(10), concat('Product: ', split_part(text, ' ', 1), ' Shirt'), CASE WHEN doc_id % 5 > 0 THEN concat('Price: 1,', CAST(doc_id % 900 + 100 AS STRING), '.50 BDT') WHEN doc_id % 2 = 0 THEN 'Price: on request' END,
CASE WHEN doc_id % 4 > 0 THEN 'Availability:   In Stock  ' END, concat('Brand: ', source), CASE WHEN doc_id % 3 > 0 THEN concat('SKU: S', CAST(doc_id AS STRING)) ELSE 'SKU:' END, concat('Type: ', lang), CASE WHEN doc_id % 3 = 0 THEN 'MATERIAL: wool' WHEN doc_id % 3 = 1 THEN 'Material: cotton' END,
CASE WHEN doc_id % 2 = 0 THEN 'color: red' END, CASE WHEN doc_id % 4 = 0 THEN 'Size Options: S, M' WHEN doc_id % 4 = 1 THEN 'sizes: L' END, CASE WHEN doc_id % 7 > 0 THEN 'Tags: a, b' END, concat('Description:', chr(10), text),
CASE WHEN doc_id % 3 > 0 THEN concat('Shipping:', chr(10), 'two days', chr(10), 'by land') END, CASE WHEN doc_id % 4 > 0 THEN concat('Return Policy:', chr(10), 'none') END, CASE WHEN doc_id % 5 > 1 THEN concat('Care Instructions:', chr(10), '  wash  ') END,
CASE WHEN doc_id % 2 = 1 THEN concat('Variants:', chr(10), '  - Red / M: 5 BDT, In Stock') END)"""


def _sql(pattern: str) -> str:
    text = f"regexp_replace(regexp_extract(c, {s(pattern)}, 1), '^\\s+|\\s+$', '', 'g')"
    return f"nullif({text}, '')"


_LINES = ", ".join(f"{_sql(line_pattern(*x))} AS {name}" for name, x in LINES.items())
_BLOCKS = ", ".join(f"md5({_sql(block_pattern(*x))}) AS {name}" for name, x in BLOCKS.items())


@query(f"""WITH r AS (SELECT doc_id, {_CONTENT.replace("AS STRING", "AS VARCHAR")} AS c FROM documents), p AS (SELECT *, {_sql(line_pattern(PRICE_LINE))} AS p FROM r)
SELECT doc_id, {_LINES}, CAST(nullif(regexp_extract(replace(p, ',', ''), {s(NUMBER)}, 0), '') AS DOUBLE) AS price, nullif(regexp_extract(p, {s(CURRENCY)}, 1), '') AS currency, {_BLOCKS} FROM p""")
def labelled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen fields of record texts made of the documents; blocks as digests."""
    rows = table(spark, sf_dir, "documents").select("doc_id", record_fields(F.expr(_CONTENT.replace("split_part(text, ' ', 1)", "element_at(split(text, ' '), 1)"))).alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", *LINES, "price", "currency", *(F.md5(name).alias(name) for name in BLOCKS))
