"""Every query with SQL agrees with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from condensa import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def canon(df):
    df = df[sorted(df.columns)]
    cell = lambda v: "NULL" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_agrees_with_sql(spark, duck, name):
    ours, theirs = core.QUERIES[name](spark, SF).toPandas(), duck.execute(core.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["savings_report", "daily_savings", "strategy_topk"])
def test_log_of_fractional_seconds_agrees_with_sql(spark, tmp_path, name):
    """Times by the edge of a day or of the window, and halves, are rounded as the SQL's cast does."""
    con, path = duckdb.connect(), tmp_path / "events.parquet"
    con.execute(f"""COPY (SELECT k::BIGINT AS event_id, TIMESTAMP '2024-01-09 00:00:00.6' - to_microseconds((k // 12 * 86400000000 + (k % 12 - 6) * 250000)::BIGINT) AS ts, k AS user_id,
      CASE k % 3 WHEN 0 THEN 'signup' WHEN 1 THEN 'click' ELSE 'view' END AS event_type, 1.5 AS value, '{{}}' AS props FROM range(100) t(k) WHERE k > 5) TO '{path}' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    assert canon(core.QUERIES[name](spark, str(tmp_path)).toPandas()) == canon(con.execute(core.SQL[name]).df())
