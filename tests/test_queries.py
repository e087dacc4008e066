"""Every query with SQL gives DuckDB's rows; the others give rows of a stable schema."""

import os

import duckdb
import pandas as pd
import pytest

from foliant.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def canonical(df: pd.DataFrame) -> list[tuple[str, ...]]:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return ""
        x = x.item() if hasattr(x, "item") else x
        return repr(round(float(x), 6)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)

    return sorted(tuple(one(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
