from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import os

import pytest
from hypothesis import HealthCheck, settings

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from clickmetrics.session import checkpoint_dir, get_spark  # noqa: E402
from clickmetrics.sources.schema import ORDER_ITEMS, ORDERS, WEBSITE_PAGEVIEWS, WEBSITE_SESSIONS  # noqa: E402
from clickmetrics.sources.tables import WebTables  # noqa: E402

# Property tests: deterministic examples by default (stable runs); HYPOTHESIS_PROFILE=deep explores more.
_HYP = dict(deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
settings.register_profile("ci", max_examples=12, derandomize=True, **_HYP)
settings.register_profile("deep", max_examples=150, **_HYP)
settings.load_profile(os.environ.get("HYPOTHESIS_PROFILE", "ci"))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[*]", 8)
    checkpoint_dir(s)
    yield s


def T(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


# Golden fixture (FIXTURES.md §2): 10 sessions, 23 hits, 3 orders, 4 items.
SESSIONS = [
    (1, T("2012-06-02 23:00:30"), 101, 0, "gsearch", "nonbrand", "g_ad_1", "mobile", "https://s"),
    (2, T("2012-06-03 10:00:00"), 101, 1, "gsearch", "nonbrand", "g_ad_1", "desktop", "https://s"),
    (3, T("2012-06-04 09:00:00"), 102, 0, "NULL", "NULL", "NULL", "desktop", "NULL"),
    (4, T("2012-08-06 12:00:00"), 103, 0, "gsearch", "nonbrand", "g_ad_1", "desktop", "https://s"),
    (5, T("2012-08-31 00:00:00"), 104, 0, "bsearch", "brand", "b_ad_1", "mobile", "https://s"),
    (6, T("2012-08-31 00:00:00"), 105, 0, "gsearch", "nonbrand", "g_ad_1", "desktop", "https://s"),
    (7, T("2012-08-31 00:00:01"), 106, 0, "gsearch", "nonbrand", "g_ad_1", "desktop", "https://s"),
    (8, T("2012-09-01 10:00:00"), 107, 0, None, None, None, "mobile", None),
    (9, T("2012-10-10 00:00:00"), 101, 1, "gsearch", "brand", "g_ad_2", "mobile", "https://s"),
    (10, T("2012-08-07 08:00:00"), None, 0, "gsearch", "nonbrand", "g_ad_1", "mobile", "https://s"),
]

PAGEVIEWS = [
    (1, T("2012-06-02 23:00:30"), 1, "/home"),
    (2, T("2012-06-03 10:00:00"), 2, "/lander-1"),
    (3, T("2012-06-03 10:00:59"), 2, "/products"),
    (4, T("2012-06-03 10:00:59"), 2, "/the-original-mr-fuzzy"),
    (5, T("2012-06-03 10:02:01"), 2, "/billing"),
    (6, T("2012-06-04 09:00:00"), 3, "/home"),
    (7, T("2012-08-06 12:00:00"), 4, "/lander-1"),
    (8, T("2012-08-06 12:01:00"), 4, "/products"),
    (9, T("2012-08-06 12:02:00"), 4, "/the-original-mr-fuzzy"),
    (10, T("2012-08-06 12:03:00"), 4, "/cart"),
    (11, T("2012-08-06 12:04:00"), 4, "/shipping"),
    (12, T("2012-08-06 12:05:00"), 4, "/billing"),
    (13, T("2012-08-06 12:06:00"), 4, "/thank-you-for-your-order"),
    (14, T("2012-08-31 00:00:00"), 5, "/home"),
    (15, T("2012-08-31 00:00:00"), 6, "/lander-1"),
    (16, T("2012-08-31 00:00:01"), 7, "/lander-1"),
    (17, T("2012-09-01 10:00:00"), 8, "/home"),
    (18, T("2012-09-01 10:00:30"), 8, "/home"),
    (19, T("2012-10-10 00:00:00"), 9, "/billing-2"),
    (20, T("2012-10-10 00:00:20"), 9, "/thank-you-for-your-order"),
    (21, T("2012-08-07 08:00:00"), 10, "/lander-1"),
    (22, T("2012-08-07 08:00:00"), 10, "/products"),
    (23, T("2012-08-07 08:00:45"), 10, "/cart"),
]

ORDER_ROWS = [(1, 4), (2, 2), (3, 9)]
ITEM_ROWS = [(1, 1, Decimal("49.99")), (2, 1, Decimal("59.99")), (3, 2, Decimal("49.99")), (4, 3, Decimal("45.99"))]


@pytest.fixture(scope="session")
def golden(spark) -> WebTables:
    return WebTables(
        sessions=spark.createDataFrame(SESSIONS, WEBSITE_SESSIONS),
        pageviews=spark.createDataFrame(PAGEVIEWS, WEBSITE_PAGEVIEWS),
        orders=spark.createDataFrame(ORDER_ROWS, ORDERS),
        order_items=spark.createDataFrame(ITEM_ROWS, ORDER_ITEMS),
    )


@pytest.fixture(scope="session")
def prepared(golden):
    from clickmetrics.plans.catalog import Prepared

    return Prepared(golden)


def rows(df, *cols):
    """Collected rows as plain tuples (selected columns, in order)."""
    if cols:
        df = df.select(*cols)
    return [tuple(r) for r in df.collect()]


def one(df):
    r = df.collect()
    assert len(r) == 1, r
    return tuple(r[0])
