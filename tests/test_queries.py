import math

import duckdb
import pytest

from assaykit.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "nation", "events", "documents", "benchmark", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, columns, order):
    key = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v
    return sorted((tuple(key(r[columns.index(c)]) for c in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", Q.SQL)
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    want = duck.sql(Q.SQL[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert plain([tuple(r) for r in got.collect()], got.columns, order) == plain(want.fetchall(), want.columns, order)
