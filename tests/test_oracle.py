"""Every query against its SQL, and contract checks on the entry points."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, queries()[name], oracle_sql()[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
