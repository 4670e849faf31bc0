"""Every registered query against its DuckDB oracle on the smallest scale factor
(the driver runs the same comparison at sf0.01); rows-only queries must run."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL
from tests.oracle_check import compare, duck

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SMALL)
    assert r.get("ok") is not False, r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["essay_id", "topic", "sent_idx", "context", "sentence"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "float": "FLOAT"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_column_types_match_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    rel = con.sql(ORACLES[name])
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert {c: _TYPES.get(t, t) for c, t in df.dtypes} == duck_types
