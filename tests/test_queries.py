"""The registered core queries against their SQL on the smallest tables."""

import duckdb
import pytest

from locusflow.plans.oracle import oracle
from locusflow.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = oracle()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def clean(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(clean(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got
    if name in SQL:
        rel = duck.sql(SQL[name])
        assert sorted(rel.columns) == cols
        want = sorted((tuple(map(clean, r)) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
        assert got == want
