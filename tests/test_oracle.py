"""Every registered query against its DuckDB oracle (row count, columns, values)."""

import pytest

import __spark_entry__ as entry
from riskloom.plans import registry
from tests.conftest import SF_SMALL
from tests.helpers import duck, duck_rows, spark_rows

QUERIES = entry.queries()
OWN = registry.queries()
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in OWN}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert sorted(OWN) == sorted(k for k in ORACLE if k in OWN)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    s_cols, s_rows = spark_rows(QUERIES[name](spark, SF_SMALL))
    d_cols, d_rows = duck_rows(con, ORACLE[name])
    assert s_cols == d_cols
    assert sum(s_rows.values()) == sum(d_rows.values())
    assert s_rows == d_rows


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "risk_level" in df.columns
