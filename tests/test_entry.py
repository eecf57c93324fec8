"""Driver contract: entry(), queries() and oracle_sql() line up; spot-check oracles."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from costlens.plans.catalog import registered_queries
from costlens.plans.oracle import oracle_queries
from tests.conftest import SF0001

CHECKED = ["admin_key_day_model", "by_model_week", "summary_today", "budget_month",
           "alias_month_summary", "key_auth_rejected", "admin_cube", "status_text"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["api_key", "key_alias", "day", "model", "spend", "requests", "tokens",
                          "prompt_tokens", "completion_tokens"]
    assert df.count() == 705


def test_every_query_has_an_oracle_but_nested():
    q, o = registered_queries(), oracle_queries()
    assert set(q) - set(o) == {"nested_report"}
    assert set(o) <= set(q)
    assert set(q) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    import datetime as dt

    import pandas as pd
    if v is pd.NaT:
        return None
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        v = dt.datetime.combine(v, dt.time())
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v


@pytest.mark.parametrize("name", CHECKED)
def test_oracle_agrees_on_sf0001(spark, name):
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    s = E.queries()[name](spark, SF0001).toPandas()
    d = con.execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(s.columns) == sorted(d.columns)
    cols = sorted(s.columns)

    def key(df):
        return sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)),
                      key=repr)
    assert key(s) == key(d)
