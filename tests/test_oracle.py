"""Every core query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from segmill.plans.queries import FOUND, SQL

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{D}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    """Values as they are, up to the last bits of a double: both sides round to the same decimals, so ties must fall alike."""
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}") + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = FOUND[name](spark, D)
    cols = sorted(df.columns)
    q = duck.sql(SQL[name])
    assert sorted(q.columns) == cols
    at = [q.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[i]) for i in at) for r in q.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    r = e.entry(spark).first()
    assert r.total_images == 1500 and 0 < r.total_anns <= 6000
    assert set(e.oracle_sql()) <= set(e.queries())
