"""Each query of the library against its SQL in DuckDB, over the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from ampliform.plans.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(pdf, columns):
    out = []
    for r in pdf[columns].itertuples(index=False):
        out.append(tuple("" if v is None or v is pd.NA or v != v else f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    assert len(got)
    if name not in ORACLE:
        return
    want = db.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
