import pytest

from sparkloom import catalogue
from tests.parity import connect, rows_of, sql_rows

REGISTRY = catalogue.load()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(spark, con, small, name):
    df = REGISTRY.queries[name](spark, small)
    rows = rows_of(df)
    if name in REGISTRY.sql:
        assert rows == sql_rows(con, REGISTRY.sql[name], df.columns)
    else:
        assert rows


def test_communities_are_groups_of_two_or_more(spark, small):
    rows = REGISTRY.queries["graph_communities"](spark, small).collect()
    assert all(r["size"] > 1 for r in rows) and len({r["node"] for r in rows}) == len(rows)


def test_packed_chunks_hold_the_lines_in_order(spark):
    from sparkloom.functions.text import packed_chunks

    lines = ["a" * 300, "b" * 150, "c" * 600, "", "d"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "")], "k int, t string")
    chunks = [r["chunk"] for r in packed_chunks(df, "k", "t").filter("k = 1").orderBy("chunk_no").collect()]
    assert chunks == [lines[0] + "\n" + lines[1], lines[2], "d"]
