"""Corpus queries that have SQL, against DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from test_oracle import compare

from lakeloom.llm.queries import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    compare(spark, name)
