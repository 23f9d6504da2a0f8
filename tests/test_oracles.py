"""Every registered raster query against its DuckDB SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from skyloom.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("supplier", "part", "orders", "lineitem", "events", "customer", "nation"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
        return None
    return float(v) if isinstance(v, (bool, int, float, np.number, np.bool_)) else str(v)


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, df.collect()), rows(columns, want.fetchall())
    assert len(got) == len(want) and all(a == pytest.approx(b, abs=2e-6) if any(isinstance(x, float) for x in a) and None not in a and not any(isinstance(x, str) for x in a) else a == b for a, b in zip(got, want, strict=True))
