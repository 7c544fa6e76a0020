"""Every query of the subpackage runs on the smallest tables; those with SQL equal it."""

import os

import duckdb
import pytest

from tessera.llm import queries as q

SQL = q.oracle_sql()


@pytest.mark.parametrize("name", q.NAMES)
def test_query(spark, sf_dir, name):
    df = q.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    if name not in SQL:
        return
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    cur = con.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(dict(zip(names, r))[c] for c in cols) for r in cur.fetchall()), key=str)
    near = lambda rows: [[round(x, 4) if isinstance(x, float) else x for x in r] for r in rows]
    assert near(got) == near(want)
