"""Cleaning and query widening by worked examples."""

import pytest

from lakeloom.operators.cleaning import clean_text, expand_query, map_column


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ""),
        ("", ""),
        ("Materials\n78% Recycled Polyester, 22% Elastane", "Materials: 78% Recycled Polyester, 22% Elastane"),
        ("Materials\nCare\nWash cold and hang to dry", "Materials\nCare: Wash cold and hang to dry"),
        ("Home\nread more\nA line that is long enough", "A line that is long enough"),
        ("short\nHeading\n৳ 500\nQ: why\na|b", "Heading\n৳ 500\nQ: why\na|b"),
        ("Same line here\nsame  LINE here\nother long line", "Same line here\nother long line"),
        ("write to me@x.org today, my friend", "write to today, my friend"),
        ("a long line with • and ☃ in it", "a long line with and in it"),
    ],
)
def test_clean_text(text, want):
    assert clean_text(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, None),
        ("  ", "  "),
        ("Black hoodie", "black hoodie dark sweatshirt"),
        ("hoodie sweatshirt", "hoodie sweatshirt pullover"),
        ("shoes under 2k", "shoes under 2000 price below 2000 BDT price below 2000 BDT footwear cost"),
        ("bag 500-800 tk", "bag price 500 to 800 BDT taka backpack cost"),
    ],
)
def test_expand_query(text, want):
    assert expand_query(text) == want


def test_as_a_column(spark):
    df = spark.createDataFrame([(1, "Materials\nCotton all through"), (2, None)], "id long, text string")
    assert {r.id: r.clean for r in map_column(df, "text", clean_text, "clean").collect()} == {1: "Materials: Cotton all through", 2: ""}
