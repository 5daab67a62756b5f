"""Every statement on the golden fixture (NULL users, text 'NULL' vs NULL, time
ties, BETWEEN edges, Sunday weeks), Spark plans with the reference's own
parameters against the literal-shape DuckDB statements over the same rows."""

from __future__ import annotations

import duckdb
import pytest

from clickmetrics.operators.conversion import REFERENCE_FUNNEL
from clickmetrics.plans.catalog import Prepared
from clickmetrics.plans.oracle import WEB_TABLES_PREFIX, statements
from clickmetrics.plans.reference import REFERENCE_ORDER_CUTOFF, REFERENCE_PLANS
from conftest import ITEM_ROWS, ORDER_ROWS, PAGEVIEWS, SESSIONS
from tools.check_oracle import canon

SQL = statements(WEB_TABLES_PREFIX, trend=("2012-06-01", "2012-08-31"), cutoff=REFERENCE_ORDER_CUTOFF,
                 funnel=(REFERENCE_FUNNEL, "2012-08-05", "2012-09-05"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("""CREATE TABLE website_sessions(website_session_id BIGINT, created_at TIMESTAMP, user_id BIGINT,
                 is_repeat_session INTEGER, utm_source VARCHAR, utm_campaign VARCHAR, utm_content VARCHAR,
                 device_type VARCHAR, http_referer VARCHAR)""")
    c.executemany("INSERT INTO website_sessions VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", SESSIONS)
    c.execute("""CREATE TABLE website_pageviews(website_pageview_id BIGINT, created_at TIMESTAMP,
                 website_session_id BIGINT, pageview_url VARCHAR)""")
    c.executemany("INSERT INTO website_pageviews VALUES (?, ?, ?, ?)", PAGEVIEWS)
    c.execute("CREATE TABLE web_orders(order_id BIGINT, website_session_id BIGINT)")
    c.executemany("INSERT INTO web_orders VALUES (?, ?)", ORDER_ROWS)
    c.execute("CREATE TABLE order_items(order_item_id BIGINT, order_id BIGINT, price_usd DECIMAL(10,2))")
    c.executemany("INSERT INTO order_items VALUES (?, ?, ?)", ITEM_ROWS)
    return c


def test_every_statement_has_golden_sql():
    assert set(SQL) == set(REFERENCE_PLANS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_golden_matches_literal_sql(spark, golden, con, name):
    df = REFERENCE_PLANS[name](Prepared(golden))
    r = con.sql(SQL[name])
    assert canon(df.columns, df.collect()) == canon(r.columns, r.fetchall())
