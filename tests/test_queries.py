import pytest

from covenant.queries import ORACLE_SQL, QUERIES
from tests.compare import connection, mismatch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_sql(spark, con, name):
    assert mismatch(spark, con, QUERIES[name], ORACLE_SQL[name], SF) is None
