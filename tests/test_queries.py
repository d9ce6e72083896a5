"""Every registered query of the library against its SQL, on the smallest tables."""

import oracle
import pytest

from lectern import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    assert oracle.compare(QUERIES[name](spark, small), SQL[name], con) == ""
