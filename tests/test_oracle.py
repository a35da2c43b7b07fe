"""Every query with SQL against DuckDB on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from quaverlake import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else round(float(value), 6) + 0.0
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    got, expected = rows(df.columns, df.collect()), rows(columns, want.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == pytest.approx(b, abs=1e-5) if all(isinstance(x, (int, float)) for x in (*a, *b)) else a == b
