"""Every core query with SQL against DuckDB on the smallest tables; the others must run with a stable schema."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from archipel.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame()
    for k in sorted(df.columns):
        col = df[k]
        if col.dtype.kind in "iuf":
            col = col.map(lambda x: None if pd.isna(x) else round(float(x), 5)).astype(object)
        elif col.dtype == object:
            col = col.map(lambda x: None if x is None or x != x else round(float(x), 5) if isinstance(x, float) else str(x))
        out[k] = col.astype(str)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, small, db):
    got = registry.queries()[name](spark, small)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.toPandas()
    if name in SQL:
        want = db.execute(SQL[name]).df()
        assert sorted(rows.columns) == sorted(want.columns)
        pd.testing.assert_frame_equal(plain(rows), plain(want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
