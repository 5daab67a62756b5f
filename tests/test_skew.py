"""A third of all events moved onto one user (which also makes giant sessions):
every plan still equals its oracle.  The skewed input is derived from the given events."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from clickmetrics.plans.catalog import CATALOG, run_on_events
from clickmetrics.sources.events import read_events
from conftest import SF001
from tools.check_oracle import canon

HOT_USER = 0
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def skewed(spark):
    ev = read_events(spark, SF001)
    return ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(HOT_USER)).otherwise(F.col("user_id")))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    path = Path(SF001) / "events.parquet"
    c.sql(f"""CREATE VIEW events AS
              SELECT event_id, ts,
                     CASE WHEN event_id % 3 = 0 THEN {HOT_USER} ELSE user_id END AS user_id,
                     event_type, value, props
              FROM read_parquet('{path}')""")
    return c


def test_hot_user_really_is_hot(con):
    share, biggest = con.sql("""
        WITH u AS (SELECT user_id, COUNT(*) n FROM events GROUP BY 1)
        SELECT MAX(n) * 1.0 / SUM(n), MAX(n) FROM u""").fetchall()[0]
    assert share > 0.33


@pytest.mark.parametrize("name", ["t12_clean_sessions", "jn6_next_event", "m04_avg_session_minutes",
                                  "m05_revenue_new_sessions", "m06_revenue_repeat_sessions", "m09_time_on_page",
                                  "m12_new_vs_repeat", "m14_entry_pages", "m16_landing_time", "m24_bounce_by_page",
                                  "m26_landing_ab_test", "m27_weekly_trend", "m28_page_scorecard",
                                  "m29_billing_test", "m31_funnel", "m34_first_session_per_user"])
def test_skewed_matches_oracle(skewed, con, name):
    assert name in CATALOG
    df = run_on_events(name, skewed)
    got = canon(df.columns, df.collect())
    r = con.sql(ORACLE[name])
    assert got == canon(r.columns, r.fetchall())
