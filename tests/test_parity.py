import pytest

from lodestone.plans import catalog
from tests.parity import DATA, connect, rows_of, rows_of_sql

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns, expected = rows_of_sql(con, ORACLE[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
