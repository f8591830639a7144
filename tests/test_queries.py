"""Every registered query against its DuckDB oracle on the smallest data."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from quillon import registry
from quillon.sources.standins import TABLES

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x) -> str:
    if x is None or (isinstance(x, float) and x != x) or str(x) in ("NaT", "<NA>"):
        return "~"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.number)):
        return f"{float(x):.5f}".replace("-0.00000", "0.00000")
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = duck.execute(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[columns].map(cell).itertuples(index=False)))
    assert rows(got) == rows(want)
