"""Every query that has SQL gives what the SQL gives."""

import pytest

from lexspark.plans import catalogue
from tests.compare import agree, connect

SQL = catalogue.sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, con, name):
    agree(catalogue.queries()[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    df = catalogue.queries()[name](spark, data)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_flagship(spark, data):
    assert catalogue.flagship(spark, data).count() > 0
