"""The step queries against their SQL, on the smallest tables."""

from pathlib import Path

import pytest

from mizan.plans import catalog, derived, live, steps

TABLES = Path("/root/testdata/sf0.001")
NAMES = [n for n, f in catalog.queries().items() if f.__module__ in (steps.__name__, live.__name__, derived.__name__)]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.skipif(not TABLES.is_dir(), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, str(TABLES))
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
