"""Every registered query against its SQL on a small scale factor."""

import duckdb
import pytest

from sievelake.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(rows):
    show = lambda v: "~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*columns).collect())
    if name in registry.oracle_sql():
        found = duck.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})").fetchall()
        assert got == plain(found)
