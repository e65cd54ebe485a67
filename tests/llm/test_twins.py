"""Queries of the training-data operators against their SQL twins."""

import os

import pytest

from cadastre.llm.queries import QUERIES, SQL
from tests.compare import oracle, rows_of

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, cur.fetchall())
    assert len(got) == len(want) > 0
    assert got == want
