"""Golden values on the hand-made fixture (FIXTURES.md §2); each pins one or more traps."""

from __future__ import annotations

import pytest

from clickmetrics.operators import bounce, conversion, engagement, landing, traffic, visitors
from clickmetrics.operators.conversion import REFERENCE_FUNNEL
from conftest import one, rows


def as_dict(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


def test_m01_m03(prepared):
    assert one(traffic.total_visits(prepared.ws)) == (10,)
    assert one(traffic.page_views(prepared.wp)) == (23,)


def test_m02_literal_and_intent(prepared):
    # The literal statement counts non-NULL user rows.
    assert one(traffic.unique_visitors(prepared.ws)) == (9, 7)


def test_m04_integer_average(prepared):
    # True mean is 0.8; the integer average truncates to 0.
    assert one(engagement.avg_session_minutes(prepared.wp, prepared.ws)) == (0,)


def test_m05_m06_revenue_by_first_ordering_session(prepared):
    # User 101's first *ordering* session is 2, not 1.
    assert one(visitors.revenue_by_visit_rank(prepared.ws, prepared.o, prepared.oi, "new")) == (159.97,)
    assert one(visitors.revenue_by_visit_rank(prepared.ws, prepared.o, prepared.oi, "repeat")) == (45.99,)


def test_m07_sources(prepared):
    got = as_dict(traffic.visits_by(prepared.ws), "utm_source", "count")
    assert got == {"Direct_Source": 1, "bsearch": 1, "gsearch": 6, None: 1}


def test_m08_pages_per_session(prepared):
    assert one(engagement.pages_per_session(prepared.wp)) == (2, 7)


def test_m09_time_on_page(prepared):
    got = as_dict(engagement.time_on_page(prepared.wp), "pageview_url", "time_on_page_min")
    assert got == {
        "/billing": 0.5, "/billing-2": 0.3, "/cart": 0.5, "/home": 0.1, "/lander-1": 0.5,
        "/products": 0.9, "/shipping": 1.0, "/the-original-mr-fuzzy": 1.0, "/thank-you-for-your-order": None,
    }


def test_m10_conversion_rate(prepared):
    assert one(traffic.conversion_rate(prepared.o, prepared.ws)) == (30.0,)


def test_m11_top_pages(prepared):
    got = rows(engagement.top_pages(prepared.wp))
    assert got == [("/home", 5), ("/lander-1", 5), ("/products", 3), ("/billing", 2), ("/cart", 2),
                   ("/thank-you-for-your-order", 2), ("/the-original-mr-fuzzy", 2), ("/billing-2", 1),
                   ("/shipping", 1)]
    assert rows(engagement.top_pages(prepared.wp, n=2)) == [("/home", 5), ("/lander-1", 5)]


def test_m12_new_vs_repeat(prepared):
    # The NULL user forms one group, as in the reference's window partitioning.
    assert one(visitors.new_vs_repeat(prepared.ws)) == (8, 2)


def test_m13_repeat_by_flag(prepared):
    assert one(visitors.repeat_by_flag(prepared.ws)) == (2, 8)
    # DIFFERENCE of two digit strings is SOUNDEX similarity 4.
    assert one(visitors.repeat_by_flag_literal(prepared.ws)) == (2, 4)


def test_m14_entry_pages_keep_ties(prepared):
    got = as_dict(engagement.entry_pages(prepared.wp), "pageview_url", "count")
    assert got == {"/lander-1": 5, "/home": 4, "/billing-2": 1, "/products": 1}


def test_m15_m23_bounce_rate(prepared):
    assert one(bounce.bounce_rate(prepared.wp, prepared.ws, where=bounce.paid(), digits=2)) == (20.0,)
    assert one(bounce.bounce_rate(prepared.wp, prepared.ws, digits=0)) == (22.0,)


def test_m16_m17_landing_time(prepared):
    assert one(landing.landing_time(prepared.wp, prepared.ws)) == (0.75,)
    got = as_dict(landing.landing_time(prepared.wp, prepared.ws, by="pageview_url"), "pageview_url", "avg_landing_min")
    assert got == {"/billing-2": 0.33, "/lander-1": 0.9, "/products": 0.75}


def test_m18_to_m22_organic(prepared):
    assert one(traffic.organic_sessions(prepared.ws)) == (1,)
    assert one(traffic.organic_users(prepared.ws)) == (1,)
    assert one(traffic.organic_reach(prepared.wp, prepared.ws)) == (1, 1)
    assert rows(traffic.organic_by_device(prepared.wp, prepared.ws)) == [("desktop", 1)]
    assert rows(traffic.organic_by_device(prepared.wp, prepared.ws, top=1)) == [("desktop", 1)]
    # NULL content is neither organic nor non-organic.
    assert one(traffic.session_reach(prepared.wp, prepared.ws)) == (8, 10)


def test_m24_bounce_by_page_drops_pages_without_bounce(prepared):
    got = as_dict(bounce.bounce_by_page(prepared.wp, prepared.ws), "pageview_url", "bounce_rate")
    assert got == {"/home": 60.0, "/lander-1": 40.0}


def test_m25_home_bounce(prepared):
    assert rows(bounce.page_bounce(prepared.wp)) == [("Home", 4, 3, 75.0)]


def test_m26_ab_test(prepared):
    got = rows(bounce.page_ab_test(prepared.wp, prepared.ws))
    assert got == [("Home", 1, 1, 100.0), ("Lander-1", 5, 2, 40.0)]


def test_m26_empty_arm_is_kept(prepared):
    got = rows(bounce.page_ab_test(prepared.wp, prepared.ws, pages={"Home": "/home", "None": "/nowhere"}))
    assert got == [("Home", 1, 1, 100.0), ("None", 0, 0, None)]


def test_m27_weekly_trend(prepared):
    import datetime as dt

    got = rows(bounce.weekly_page_trend(prepared.wp, prepared.ws))
    assert got == [
        (dt.datetime(2012, 5, 28), "/home", 1, 1, 100.0),
        (dt.datetime(2012, 6, 4), "/lander-1", 1, 0, 0.0),
        (dt.datetime(2012, 8, 6), "/lander-1", 2, 0, 0.0),
        (dt.datetime(2012, 8, 27), "/lander-1", 1, 1, 100.0),
    ]


def test_m28_scorecard(prepared):
    got = {r[0]: tuple(r[1:]) for r in rows(landing.page_scorecard(prepared.wp, prepared.ws))}
    expect = {
        "/home": (5, 624, 3, 30.0, 0.0),
        "/lander-1": (4, 360, 2, 20.0, 20.0),
        "/billing": (2, 663, 0, 0.0, 50.0),
        "/products": (2, 600, 0, 0.0, 100.0 / 3),
        "/thank-you-for-your-order": (2, 363, 0, 0.0, 100.0),
        "/the-original-mr-fuzzy": (2, 661, 0, 0.0, 50.0),
        "/billing-2": (1, 0, 0, 0.0, 100.0),
        "/cart": (1, 601, 0, 0.0, 50.0),
        "/shipping": (1, 724, 0, 0.0, 100.0),
    }
    assert got.keys() == expect.keys()
    for url, (views, minute, single, rate, conv) in expect.items():
        g = got[url]
        assert g[:3] == (views, minute, single), url
        assert g[3] == pytest.approx(rate) and g[4] == pytest.approx(conv), url


def test_m29_m30_billing(prepared):
    assert sorted(rows(conversion.page_order_rate(prepared.wp, prepared.o))) == [
        ("/billing", 2, 2, 1.0), ("/billing-2", 1, 1, 1.0)]
    # strict cut-off: the /billing-2 hit at exactly 2012-10-10 00:00 is excluded
    assert rows(conversion.page_order_rate(prepared.wp, prepared.o, before="2012-10-10")) == [("/billing", 2, 2, 1.0)]


def test_m31_funnel(prepared):
    out = conversion.funnel(prepared.wp, prepared.ws, REFERENCE_FUNNEL, start="2012-08-05", end="2012-09-05")
    assert out.columns == ["total_sessions", "product_page", "fuzzy_page", "cart_page", "shipping_page",
                           "billing_page", "thankyou_page", "products_click_rate", "fuzzy_click_rate",
                           "cart_click_rate", "shipping_click_rate", "billing_click_rate", "thankyou_click_rate"]
    assert one(out) == (4, 2, 1, 1, 1, 1, 1, 50.0, 50.0, 100.0, 100.0, 100.0, 100.0)


def test_m31_funnel_is_set_membership(prepared):
    # Session 2 has /billing without /cart, so it stops at fuzzy.
    out = conversion.funnel(prepared.wp, prepared.ws, REFERENCE_FUNNEL, start="2012-06-01", end="2012-09-05")
    assert one(out.select("total_sessions", "product_page", "fuzzy_page", "cart_page", "shipping_page",
                          "billing_page", "thankyou_page")) == (6, 3, 2, 1, 1, 1, 1)


def test_m32_funnel_rates_only(prepared):
    out = conversion.funnel(prepared.wp, prepared.ws, REFERENCE_FUNNEL, start="2012-08-05", end="2012-09-05", rates_only=True)
    assert out.columns == ["total_sessions", "products_click_rate", "fuzzy_click_rate", "cart_click_rate",
                           "shipping_click_rate", "billing_click_rate", "thankyou_click_rate"]
    assert one(out) == (4, 50.0, 50.0, 100.0, 100.0, 100.0, 100.0)


def test_m33_paid_pages(prepared):
    got = {r[0] for r in rows(traffic.paid_pages(prepared.wp, prepared.ws))}
    assert got == {"/home", "/lander-1", "/products", "/the-original-mr-fuzzy", "/billing", "/cart",
                   "/shipping", "/thank-you-for-your-order", "/billing-2"}


def test_m34_first_session_per_user(prepared):
    got = sorted(rows(visitors.first_session_per_user(prepared.ws)), key=lambda r: (r[0] is not None, r[0]))
    assert got == [(None, 10), (101, 1), (102, 3), (103, 4), (104, 5), (105, 6), (106, 7), (107, 8)]


def test_t1_t2_labels_text_marker_only(prepared):
    got = {r[0]: r[1:] for r in rows(prepared.ws, "website_session_id", "utm_source", "utm_content")}
    assert got[3] == ("Direct_Source", "Direct_Search")
    assert got[8] == (None, None)  # real NULLs untouched (X1)


def test_t3_derived_table(prepared):
    sp = prepared.sp
    assert sp.columns == ["pageview_url", "created_at", "website_pageview_id", "website_session_id",
                          "device_type", "is_repeat_session", "user_id", "utm_campaign", "utm_content",
                          "utm_source", "http_referer"]
    assert sp.count() == 23
