"""The named analyses: each reference statement as a plan over :class:`WebTables`.

``CATALOG[name](tables)`` returns a DataFrame.  ``tables`` holds *raw*
sessions; every plan cleans first (clean -> derive -> measure).  Where the
reference hard-codes 2012 dates, the catalog passes dates inside the test
data (January 2024); the operators keep the reference literals as defaults.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmetrics.constants import CAMPAIGN_NAME, CAMPAIGN_SOURCE, FUNNEL_STEPS, HOME_LABEL, HOME_PAGE
from clickmetrics.operators import bounce, conversion, engagement, landing, traffic, visitors
from clickmetrics.operators.prepare import clean_sessions, session_pageviews
from clickmetrics.operators.semi import rows_of_keys
from clickmetrics.operators.sessions import HIT, SESSION, counted_hits, grouped_hit_ranks, hit_ranks, next_later_time, visit_ranks
from clickmetrics.session import checkpoint_dir
from clickmetrics.sources.events import SESSION_GAP_SECONDS, load_from_events, read_events, web_tables_for, with_k
from clickmetrics.sources.incremental import derive_step, read_steps
from clickmetrics.sources.sink import save_table, use_database
from clickmetrics.sources.tables import WebTables

# Fixed test-data parameters (the test clickstream covers 2024-01-01 .. 2024-01-30).
TREND_START, TREND_END = "2024-01-03", "2024-01-24"
ORDER_CUTOFF = "2024-01-15"
FUNNEL_START, FUNNEL_END = "2024-01-01", "2024-01-31"


class Prepared:
    """Cleaned sessions and the derived table, built lazily from raw :class:`WebTables`."""

    def __init__(self, raw: WebTables):
        self.raw = raw
        self.ws = clean_sessions(raw.sessions)
        self.wp = raw.pageviews
        self.o = raw.orders
        self.oi = raw.order_items

    @property
    def sp(self) -> DataFrame:
        return session_pageviews(self.wp, self.ws)


Plan = Callable[[Prepared], DataFrame]

CATALOG: dict[str, Plan] = {
    # D3: browsing the base tables (whole tables, raw: the text 'NULL' markers are still there).
    "d3_website_sessions": lambda t: t.raw.sessions,
    "d3_website_pageviews": lambda t: t.raw.pageviews,
    "d3_orders": lambda t: t.raw.orders,
    "d3_order_items": lambda t: t.raw.order_items,
    "t12_clean_sessions": lambda t: t.ws,
    "t3_session_pageviews": lambda t: t.sp,
    "jn6_next_event": lambda t: next_later_time(t.wp, spread_by=("website_pageview_id",)).select(
        "website_pageview_id", "website_session_id", "created_at", "next_ts"),
    # WN: the reference's DENSE_RANK() expressions as columns.
    "wn1_visit_rank": lambda t: visit_ranks(t.ws),
    "wn2_hit_rank": lambda t: hit_ranks(t.wp),
    "wn3_grouped_rank": lambda t: grouped_hit_ranks(t.wp, t.ws.filter(bounce.paid())),
    # WN-4 at row grain; FL-6 / JN-8 at row grain: every hit of the campaign's sessions.
    "wn4_hit_count": lambda t: counted_hits(t.wp),
    "fl6_campaign_hits": lambda t: rows_of_keys(t.wp, t.ws.filter(
        (F.col("utm_source") == CAMPAIGN_SOURCE) & (F.col("utm_campaign") == CAMPAIGN_NAME)), SESSION, spread_by=(HIT,)),
    "m01_total_visits": lambda t: traffic.total_visits(t.ws),
    "m02_unique_visitors": lambda t: traffic.unique_visitors(t.ws),
    "m03_page_views": lambda t: traffic.page_views(t.wp),
    "m04_avg_session_minutes": lambda t: engagement.avg_session_minutes(t.wp, t.ws),
    "m05_revenue_new_sessions": lambda t: visitors.revenue_by_visit_rank(t.ws, t.o, t.oi, "new"),
    "m06_revenue_repeat_sessions": lambda t: visitors.revenue_by_visit_rank(t.ws, t.o, t.oi, "repeat"),
    "m07_visits_by_source": lambda t: traffic.visits_by(t.ws, "utm_source"),
    "m08_pages_per_session": lambda t: engagement.pages_per_session(t.wp),
    "m09_time_on_page": lambda t: engagement.time_on_page(t.wp),
    "m10_conversion_rate": lambda t: traffic.conversion_rate(t.o, t.ws),
    "m11_top_pages": lambda t: engagement.top_pages(t.wp),
    "m12_new_vs_repeat": lambda t: visitors.new_vs_repeat(t.ws),
    "m13_repeat_by_flag": lambda t: visitors.repeat_by_flag(t.ws),
    "m13_literal_difference": lambda t: visitors.repeat_by_flag_literal(t.ws),
    "m14_entry_pages": lambda t: engagement.entry_pages(t.wp),
    "m15_paid_bounce_rate": lambda t: bounce.bounce_rate(t.wp, t.ws, where=bounce.paid(), digits=2),
    "m16_landing_time": lambda t: landing.landing_time(t.wp, t.ws),
    "m17_landing_time_by_page": lambda t: landing.landing_time(t.wp, t.ws, by="pageview_url"),
    "m18_organic_sessions": lambda t: traffic.organic_sessions(t.ws),
    "m19_organic_users": lambda t: traffic.organic_users(t.ws),
    "m20_organic_reach": lambda t: traffic.organic_reach(t.wp, t.ws),
    "m21_organic_by_device": lambda t: traffic.organic_by_device(t.wp, t.ws),
    "m21_top_organic_device": lambda t: traffic.organic_by_device(t.wp, t.ws, top=1),
    "m22_session_reach": lambda t: traffic.session_reach(t.wp, t.ws),
    "m23_bounce_rate": lambda t: bounce.bounce_rate(t.wp, t.ws, digits=0),
    "m24_bounce_by_page": lambda t: bounce.bounce_by_page(t.wp, t.ws),
    "m25_home_bounce": lambda t: bounce.page_bounce(t.wp, HOME_PAGE, HOME_LABEL),
    "m26_landing_ab_test": lambda t: bounce.page_ab_test(t.wp, t.ws),
    "m27_weekly_trend": lambda t: bounce.weekly_page_trend(t.raw.hits(TREND_START, TREND_END), t.ws, start=TREND_START, end=TREND_END),
    "m28_page_scorecard": lambda t: landing.page_scorecard(t.wp, t.ws),
    "m29_billing_test": lambda t: conversion.page_order_rate(t.wp, t.o),
    "m30_billing_test_cutoff": lambda t: conversion.page_order_rate(t.raw.hits(end=ORDER_CUTOFF), t.o, before=ORDER_CUTOFF),
    "m31_funnel": lambda t: conversion.funnel(t.raw.hits(FUNNEL_START, FUNNEL_END), t.ws, FUNNEL_STEPS, start=FUNNEL_START, end=FUNNEL_END),
    "m32_funnel_rates": lambda t: conversion.funnel(t.raw.hits(FUNNEL_START, FUNNEL_END), t.ws, FUNNEL_STEPS, start=FUNNEL_START, end=FUNNEL_END,
                                                    rates_only=True),
    "m33_paid_pages": lambda t: traffic.paid_pages(t.wp, t.ws),
    "m34_first_session_per_user": lambda t: visitors.first_session_per_user(t.ws),
}


INCREMENTAL_STEPS = ("2024-01-10", "2024-01-11 12:30:00", "2024-01-20", "2024-02-01")


def incremental_sessions(spark: SparkSession, sf_dir: str, steps: tuple[str, ...] = INCREMENTAL_STEPS) -> DataFrame:
    """SRC-3 / T3: the events of ``sf_dir`` taken in by steps into a fresh folder under the checkpoint folder; every
    event with its session, as one derivation of all events gives them."""
    events = with_k(read_events(spark, sf_dir))
    root = os.path.join(checkpoint_dir(spark), "web_tables", f"steps-{uuid.uuid4().hex}")
    for until in steps:
        derive_step(spark, events, root, until, SESSION_GAP_SECONDS)
    return read_steps(spark, root, SESSION_GAP_SECONDS).select("event_id", "user_id", "session_id", "session_seq", "at_session_start")


def saved_table(spark: SparkSession, sf_dir: str, database: str = "web_analytics") -> DataFrame:
    """D1, D2, SRC-3, SRC-4: create a database under the checkpoint folder, use it, write the derived table into it
    (T3, a table of its own in each run) and read it back from the catalog by name.  The session's
    current database is as before afterwards."""
    before = spark.catalog.currentDatabase()
    derived = Prepared(web_tables_for(spark, sf_dir)).sp
    table = f"website_session_pageviews_{uuid.uuid4().hex}"
    root = os.path.join(checkpoint_dir(spark), "databases", database)
    use_database(spark, database, root)
    try:
        save_table(derived, path=os.path.join(root, table), name=table)
        return spark.table(f"`{database}`.`{table}`")
    finally:
        spark.catalog.setCurrentDatabase(before)


def visitor_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-3, AG-5, AG-6: distinct visitors by day, week and in all, merged from daily bitmaps in a table of its own."""
    ws = Prepared(web_tables_for(spark, sf_dir)).ws
    return traffic.visitor_reach(ws, f"visitor-bitmaps-{uuid.uuid4().hex}")


# Queries that write tables of their own on the way.
EVENT_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "src3_incremental_sessions": incremental_sessions, "src4_saved_table": saved_table,
    "ag6_visitor_reach": visitor_reach}


def run_on_events(name: str, events: DataFrame) -> DataFrame:
    """Run catalog plan ``name`` on web tables derived (lazily) from an ``events`` DataFrame."""
    from clickmetrics.sources.events import web_tables_from_events

    return CATALOG[name](Prepared(web_tables_from_events(events)))


def run(name: str, spark: SparkSession, sf_dir: str, materialized: bool = True) -> DataFrame:
    """Run catalog plan ``name`` on web tables derived from ``<sf_dir>/events.parquet``.

    By default the derived tables are written once (per application and
    input version) and shared by all plans; ``materialized=False`` derives
    them inside the plan itself.
    """
    raw = web_tables_for(spark, sf_dir) if materialized else load_from_events(spark, sf_dir)
    return CATALOG[name](Prepared(raw))


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(name, spark, sf_dir)

    q.__name__ = name
    return q
