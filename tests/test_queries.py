"""Every query over the ledger operators equals its DuckDB twin on the
smallest tables (tests/llm has those of the training-data operators)."""

import pytest

import __spark_entry__ as E
from oracle_compare import digest, duck
from tally.plans.table_queries import QUERIES as TABLE_QUERIES

SF = "/root/testdata/sf0.001"
QUERIES = {k: v for k, v in E.queries().items() if k in TABLE_QUERIES}
SQL = {k: v for k, v in E.oracle_sql().items() if k in TABLE_QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "category_id", "matched_by"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert digest(df.columns, rows) == digest(dcols, res.fetchall())
