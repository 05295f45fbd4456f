"""Every query of the catalogue against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quadlight import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.execute(f"create view {name} as select * from read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    got = df.collect()
    if name not in queries.oracle_sql():
        assert got is not None
        return
    cursor = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    row = lambda r: tuple(plain(r[c]) for c in sorted(columns))
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(map(row, got), key=repr) == sorted(map(row, want), key=repr)
