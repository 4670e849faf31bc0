"""Query registry.

A query is ``fn(spark, sf_dir) -> DataFrame``.  ``oracle`` is an independent
DuckDB restatement over the same Parquet tables (None when the operator is not
SQL-expressible: iterative fits, RNG-based resampling, streaming).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    ids: str  # SURVEY inventory ids covered


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, oracle, ids)
        return fn
    return deco
