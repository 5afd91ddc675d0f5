"""Every query that has oracle SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from gridloom.plans import reference

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return list(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(reference.ORACLE))
def test_query_agrees_with_sql(spark, duck, name):
    df = reference.QUERIES[name](spark, SF)
    got = duck.sql(reference.ORACLE[name])
    assert sorted(df.columns) == sorted(got.columns)
    cols = sorted(df.columns)
    rows = sorted((tuple(str(norm(r[c])) for c in cols) for r in df.collect()))
    at = [got.columns.index(c) for c in cols]
    assert rows == sorted(tuple(str(norm(r[i])) for i in at) for r in got.fetchall())
