"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from lexisift.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return list(v) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_rows_match(spark, con, name):
    df = catalogue.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(str(_plain(r[c])) for c in cols) for r in df.collect()))
    found = con.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(str(_plain(r[names.index(c)])) for c in cols) for r in found.fetchall())
