"""Every query of the engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from ledgerloom.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    expected = duck.sql(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, expected))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLE)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
