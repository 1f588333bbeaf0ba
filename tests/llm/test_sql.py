import pytest

from sparkloom.llm import queries
from tests.parity import connect, rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, small, name):
    df = queries.queries()[name](spark, small)
    assert rows_of(df) == sql_rows(connect(small), queries.oracle_sql()[name], df.columns)


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
