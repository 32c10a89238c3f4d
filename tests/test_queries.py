"""Every query with a SQL twin gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lodestone.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    def show(v):
        if pd.isna(v):
            return ""
        return f"{float(v):.6f}" if not isinstance(v, str | bool) and hasattr(v, "__float__") and not hasattr(v, "isoformat") else str(v)

    return sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


#: Rows that a query without a SQL twin gives: those of a table, or of its own in the tests of its operator.
ROWS = {
    "c6_drop_duplicates_in_order": "SELECT count(*) FROM documents", "d4_live_reuse": "SELECT count(*) FROM documents", "d5_leaders": "SELECT count(*) FROM documents",
    "d6_achievement_groups": "SELECT count(*) FROM conversations", "f1_rate_limit": "SELECT count(*) FROM events", "f2_rate_limit_stream": "SELECT count(*) FROM events",
    "f4_idempotent_create": "SELECT count(*) FROM events", "f4_idempotent_stream": "SELECT count(*) FROM events", "g4_anchor_clusters": "SELECT count(*) FROM events",
    "b5_approximate_nearest": "SELECT 3 * count(*) FROM embeddings WHERE vec_id % 50 = 0",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, duck, name):
    got = QUERIES[name](spark, SF).count()
    assert got == duck.execute(ROWS[name]).fetchone()[0] if name in ROWS else got > 0
