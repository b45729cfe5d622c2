"""Registered queries equal their SQL in DuckDB on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from vantagrain import plans

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        if hasattr(x, "item"):
            x = x.item()
        return round(float(x), 5) if not isinstance(x, str | bool | int) else x

    rows = [tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


#: One in three of the queries; with ORACLE_ALL set, all of them.
SAMPLE = [n for k, n in enumerate(sorted(plans.SQL)) if k % 3 == 0 or os.environ.get("ORACLE_ALL")]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    got = plain(plans.QUERIES[name](spark, str(DATA)).toPandas())
    want = plain(duck.execute(plans.SQL[name]).fetch_df())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(not isinstance(v, str) for v in a) else all(
            x == y or (isinstance(x, float) and abs(x - y) < 2e-5) for x, y in zip(a, b, strict=True)
        )
