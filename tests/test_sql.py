"""Each query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from loomstead.plans import ORACLE

duckdb = pytest.importorskip("duckdb")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.fixture(scope="module")
def connection(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees(spark, small, connection, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    run = connection.execute(ORACLE[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in run.fetchall()), key=repr)
    assert got == want
