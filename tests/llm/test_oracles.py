import pytest

from sparkloom.llm import queries

from ..compare import connect, difference

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    assert not difference(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])
