"""Addresses that scripts call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: how scripts name the addresses that they call, and how many are kept.
ENDPOINTS = (r"""["'](/api/[^"'?\s]{3,60})["']""", r"""["'](https?://[^"'?\s]+/api/[^"'?\s]{3,60})["']""", r"""fetch\(["']([^"'?\s]{5,80})["']""", r"""axios\.[a-z]+\(["']([^"'?\s]{5,80})["']""")
MOST = 20


def script_endpoints(script: Column, base: Column) -> Column:
    """The first twenty different addresses that a script calls, made absolute against ``base``; empty for null."""
    found = F.concat(*(F.regexp_extract_all(F.coalesce(script, F.lit("")), F.lit(p), 1) for p in ENDPOINTS))
    origin, folder = F.regexp_extract(base, "^[a-z]+://[^/?#]+", 0), F.regexp_extract(base, "^[a-z]+://[^/?#]+[^?#]*/|^[a-z]+://[^/?#]+", 0)
    whole = lambda x: F.when(x.startswith("http"), x).when(x.startswith("/"), F.concat(origin, x)).otherwise(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"), x))
    return F.slice(F.array_distinct(F.transform(found, whole)), 1, MOST)
