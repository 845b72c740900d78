"""The contract: every query has its SQL, and both give the same rows on the smallest tables."""

import os

import pytest

import basketwise.bindings as bindings
import basketwise.bindings_upkeep  # noqa: F401  registers its queries too

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(bindings.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = bindings.QUERIES[name](spark, SF)
    want = con.execute(bindings.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    tidy = lambda rows: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
    assert tidy(tuple(r) for r in df.select(names).collect()) == tidy(want.fetchall())


def test_entry():
    import __spark_entry__ as entry

    assert set(bindings.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
