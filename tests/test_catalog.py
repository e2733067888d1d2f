import oracle
import pytest

from docsieve import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", catalog.queries())
def test_same_as_sql(spark, name):
    oracle.compare(catalog.queries()[name](spark, oracle.DATA), SQL[name])
