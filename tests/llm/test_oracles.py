"""The queries that SQL can express against it, at the smallest scale."""

import pytest

from quillstone.llm import queries
from tests.test_oracles import duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, duck, name):  # noqa: F811
    out = queries.QUERIES[name](spark, sf)
    want = duck.sql(queries.ORACLES[name])
    cols = sorted(out.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    mine = sorted(repr([plain(r[c]) for c in cols]) for r in out.collect())
    assert mine == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
