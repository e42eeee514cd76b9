"""Every query with oracle SQL must equal DuckDB on the test tables; every
query must run and return a stable schema."""

import pytest

import __spark_entry__ as E
from payscope import plans
from tests.conftest import SF001
from tests.oracle_harness import compare, duck

QUERIES = plans.queries()
ORACLE = plans.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["payment_method", "total_transactions", "failed_transactions", "failure_rate"]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], SF001)
    assert r["status"] == "ok", r


#: Queries of other subpackages have their own tests.
ROWS_ONLY = sorted(n for n in plans.queries() if n not in ORACLE)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_sql_runs_and_can_be_written(spark, tmp_path, name):
    QUERIES[name](spark, SF001).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
