"""Every query against its SQL on the same tables."""

import math
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


def rows(cols, found):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def plain(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else repr(float(x)) if isinstance(x, float) else bytes(x) if isinstance(x, bytearray) else x

    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in Path(SF).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    got, want = rows(df.columns, df.collect()), rows(cols, want.fetchall())
    assert got == want and got


def test_queries_without_sql(spark):
    for name in entry.queries().keys() - entry.oracle_sql().keys():
        if not name.startswith("op") and name != "pipeline":
            assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4
