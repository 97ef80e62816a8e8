"""Every query of the catalogue runs, and tells the rows that its SQL tells."""

import os

import duckdb
import pytest

from papyra.plans import catalogue

Q, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df):
    cols = sorted(df.columns)
    x = df[cols].astype(object).where(df[cols].notna(), None)
    return cols, sorted(tuple(map(repr, map(plain, r))) for r in x.values.tolist())


@pytest.mark.parametrize("name", sorted(Q))
def test_query(name, spark, sf, duck):
    got = Q[name](spark, sf).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.execute(SQL[name]).df())
    else:
        assert len(got.columns)
