"""Every registered query of the main library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from chatloom.plans.all import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(frame):
    def cell(v):
        if v is None or (not isinstance(v, list | dict) and pd.isna(v)):
            return "null"
        if hasattr(v, "item"):
            v = v.item()
        return str(v) if isinstance(v, bool | str) else repr(round(float(v), 9)) if isinstance(v, int | float) else str(v)

    return sorted(tuple(map(cell, row)) for row in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
