"""Every core query against its SQL on the smallest tables."""

import os

import pytest

from sluice.plans import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def normal(rows):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        p = f"{SF}/{f}"
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query(spark, duck, name):
    got = core.queries()[name](spark, SF)
    want = duck.execute(core.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert normal(got.select(*names).collect()) == normal(want.fetchall())


def test_gated_queries_give_rows(spark):
    for name in ("token_bucket", "sliding_window_gate"):
        assert core.queries()[name](spark, SF).count() > 0
