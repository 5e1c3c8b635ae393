import os

import pytest

SF = "/root/testdata/sf0.001"


def names():
    from corpuslode.plans import catalog

    return sorted(catalog.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", names())
def test_against_sql(spark, name):
    """Every query that SQL can express, on the smallest tables."""
    import duckdb

    from corpuslode.plans import catalog

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, SF)
    key = lambda rows: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert key(got.select(*want.columns).collect()) == key(want.fetchall())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
