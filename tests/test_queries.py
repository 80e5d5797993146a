"""Every query against its SQL on DuckDB; those without SQL only run."""

import glob
import math
import os

import duckdb
import pytest

from lattiq.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9) + 0.0
        if isinstance(x, (list, tuple)):
            return tuple(plain(y) for y in x)
        return x

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf, name):
    if not glob.glob(os.path.join(sf, "*.parquet")):
        pytest.skip("no test data")
    df = registry.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = duck.execute(sql)
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = normal(got.fetchall(), columns)
    have = normal(rows, df.columns)
    assert len(want) == len(have) and have
    assert want == have
