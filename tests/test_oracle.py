import pytest

from ledgerlens import catalog
from tests.oracle import DATA, connect, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert spark_rows(catalog.queries()[name](spark, DATA)) == sql_rows(con, catalog.oracle_sql()[name])


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).count() > 0
