"""Every query against its SQL in DuckDB, at the smallest scale; those without SQL must give rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillstone import catalog, plans  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return f"{v:.9g}" if abs(v) < 10**9 else str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    out = catalog.QUERIES[name](spark, sf)
    rows = [r.asDict() for r in out.collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(out.columns) == sorted(want.columns)
    cols = sorted(out.columns)
    at = [want.columns.index(c) for c in cols]
    mine = sorted(repr([plain(r[c]) for c in cols]) for r in rows)
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_llm():
    root = os.path.dirname(entry.__file__)
    for folder, _, files in os.walk(os.path.join(root, "quillstone")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f), encoding="utf-8") as h:
                        assert "quillstone.llm" not in h.read(), f
