"""Every corpus query that has SQL equals DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from vantagrain.llm.queries import QUERIES, SQL

from ..test_oracle import DATA, TABLES, plain

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.execute(SQL[name]).fetch_df()
    assert set(got.columns) == set(want.columns)
    assert plain(got) == plain(want)
