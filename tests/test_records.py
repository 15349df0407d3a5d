from pyspark.sql import functions as F

from lakeloom.functions.records import record_fields

TEXT = """Product:  Red Cap
Price: ৳ 1,390.50 only
price: 7
Availability: In Stock
Brand: Acme\r
SKU: S-1
SKU: S-2
Type: caps
MATERIAL: wool
color: Red
Sizes: S, M
Tags: a, b
Description:
First line.

Second: line.
Shipping:
two days
Return Policy:
no returns
Care Instructions:
wash
cold
Variants:
  - Red / M: 5.00 BDT, In Stock, SKU: V1
  - Blue"""


def run(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, content string").orderBy("k")
    return [r[0].asDict() for r in rows.select(record_fields(F.col("content")).alias("x")).collect()]


def test_all_fields(spark):
    (got,) = run(spark, TEXT)
    assert got == {
        "title": "Red Cap", "availability": "In Stock", "brand": "Acme", "sku": "S-1", "product_type": "caps", "material": "wool", "color": "Red", "size_options": "S, M", "tags": "a, b", "price": 1390.5, "currency": "৳",
        "description": "First line.\n\nSecond: line.", "shipping_info": "two days", "return_policy": "no returns", "care_instructions": "wash\ncold", "variants": "- Red / M: 5.00 BDT, In Stock, SKU: V1\n  - Blue",
    }


def test_what_is_missing_or_out_of_order(spark):
    none, empty, some, turned = run(spark, None, "", "brand: x\nPrice: on request, USD\nTitle Product: no\nDescription: inline", "Variants:\n - a\nShipping:\nfast\nDescription:\nlast")
    assert set(none.values()) == set(empty.values()) == {None}
    assert {k: v for k, v in some.items() if v is not None} == {"currency": "USD"}
    assert {k: v for k, v in turned.items() if v is not None} == {"variants": "- a", "shipping_info": "fast\nDescription:\nlast", "description": "last"}


def test_long_text(spark):
    (got,) = run(spark, "Description:\n" + "word " * 200_000 + "\nReturn Policy:\nnone")
    assert len(got["description"]) == 5 * 200_000 - 1 and got["return_policy"] == "none"
