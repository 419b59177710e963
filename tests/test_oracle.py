"""Every registered query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from quern import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 8) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in cols) for r in df.collect()), key=str)
    found = duck.execute(queries.SQL[name])
    names = [x[0] for x in found.description]
    want = sorted((tuple(cell(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
    assert sorted(names) == cols
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
