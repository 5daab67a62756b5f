"""Values FIXTURES.md §3 lists for the events-derived tables at sf0.01 (an
independent transcription), checked against the registered queries."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from conftest import SF001

Q = E.queries()


def rows(spark, name):
    return [tuple(r) for r in Q[name](spark, SF001).collect()]


@pytest.mark.parametrize("name, expect", [
    ("m04_avg_session_minutes", [(602,)]),
    ("m05_revenue_new_sessions", [(15588.62,)]),
    ("m06_revenue_repeat_sessions", [(126517.41,)]),
    ("m08_pages_per_session", [(3, 18)]),
    ("m12_new_vs_repeat", [(150, 3142)]),
    ("m16_landing_time", [(298.08,)]),
])
def test_scalar_probes(spark, name, expect):
    assert rows(spark, name) == expect


def test_table_probes(spark):
    assert sorted(rows(spark, "m07_visits_by_source")) == [("Direct_Source", 667), ("bsearch", 647), ("gsearch", 1978)]
    assert [r[:3] for r in rows(spark, "m25_home_bounce")] == [("Home", 798, 89)]
    assert [r[:3] for r in rows(spark, "m26_landing_ab_test")] == [("Home", 325, 34), ("Lander-1", 334, 43)]
    assert len(rows(spark, "m27_weekly_trend")) == 8
    assert sorted(r[:3] for r in rows(spark, "m29_billing_test")) == [("/billing", 1339, 1094), ("/billing-2", 675, 504)]
    # 1,307 sessions; then the sessions that reach steps 2 to 7.
    assert rows(spark, "m31_funnel")[0][:7] == (1307, 127, 22, 11, 3, 1, 1)
    assert Q["t12_clean_sessions"](spark, SF001).count() == 3292
    assert Q["d3_website_pageviews"](spark, SF001).count() == 10000
    assert Q["d3_orders"](spark, SF001).count() == 1981
    assert Q["d3_order_items"](spark, SF001).count() == 2995
