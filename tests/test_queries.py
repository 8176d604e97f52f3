"""Every query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from palimpsest.plans.catalog import QUERIES, SQL
from palimpsest.plans.fixtures import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def norm(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = norm(df.select(*cols).collect())
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert got == norm(tuple(r[i] for i in at) for r in want.fetchall())
