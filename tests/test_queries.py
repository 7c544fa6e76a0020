"""The core queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import queries as core

SQL = core.oracle_sql()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else float(f"{v:.6g}") + 0.0
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.6g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def views(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, sf_dir, views, name):
    df = core.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in SQL:
        assert cols
        return
    cur = views.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want
