"""Rows and values that must not get lost: unpriced sessions, missing k, large prices, very hot keys."""

from __future__ import annotations

import pytest

from clickmetrics.operators.joins import hot_keys
from clickmetrics.operators.visitors import revenue_by_visit_rank
from clickmetrics.sources.events import web_tables_from_events
from conftest import T, one


def _revenue(spark, items, which):
    ws = spark.createDataFrame([(1, 7), (2, 7)], "website_session_id long, user_id long")
    o = spark.createDataFrame([(10, 1), (20, 2)], "order_id long, website_session_id long")
    oi = spark.createDataFrame(items, "order_item_id long, order_id long, price_usd double")
    oi = oi.withColumn("price_usd", oi["price_usd"].cast("decimal(18,2)"))
    return one(revenue_by_visit_rank(ws, o, oi, which))[0]


def test_repeat_revenue_after_an_unpriced_first_session(spark):
    assert _revenue(spark, [(1, 10, None), (2, 20, 20.0)], "repeat") == 20.0


def test_no_repeat_order_is_null(spark):
    assert _revenue(spark, [(1, 10, 5.0)], "repeat") is None


def _events(spark, value, props):
    return spark.createDataFrame([(1, T("2024-01-01 00:00:00"), 5, "purchase", value, props)],
                                 "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


@pytest.mark.parametrize("props", ["{}", None, '{"k": 99999999999}'])
def test_order_without_k_keeps_an_item_and_is_direct(spark, props):
    t = web_tables_from_events(_events(spark, 2e8, props))
    assert [(r["order_id"], float(r["price_usd"])) for r in t.order_items.collect()] == [(1, 2e8)]
    s = t.sessions.first()
    assert (s["utm_source"], s["utm_campaign"], s["utm_content"], s["http_referer"]) == ("NULL",) * 4


def test_price_beyond_the_type_fails(spark):
    with pytest.raises(Exception, match="price out of range"):
        web_tables_from_events(_events(spark, 1e17, '{"k": 1}')).order_items.collect()


def test_fan_out_has_no_cap(spark):
    counts = spark.createDataFrame([(1, 330_000_000_000), (2, 5)], "k long, n long")
    assert [tuple(r) for r in hot_keys(counts, ["k"], "n").collect()] == [(1, 165_000)]
