"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from paperloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool | int):
        return str(int(v))
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not there")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    relation = duck.sql(catalog.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    order = [relation.columns.index(n) for n in names]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in relation.fetchall()), key=str)
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str) == expected
