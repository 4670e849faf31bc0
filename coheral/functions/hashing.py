"""Deterministic, seedable pseudo-random draws.

Spark rows have no order and ``rand()`` depends on partitioning, so every random
choice in the library is a function of (seed, row key).  MD5 is used because the
same digest is available in Spark SQL, DuckDB and Python, which lets the SQL
oracle and the unit tests restate each draw exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(key: Column, seed: int | str) -> Column:
    """32-hex-digit sort key, uniform over rows: md5('<seed>:' || key)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def coin(key: Column, seed: int | str) -> Column:
    """Fair coin: True when the first hex digit of ``hash_key`` is below 8."""
    return F.substring(hash_key(key, seed), 1, 1) < F.lit("8")
