"""Conversion: page-to-order rates and the multi-step funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmetrics.constants import (BILLING_PAGES, CAMPAIGN_NAME, CAMPAIGN_SOURCE, FUNNEL_END, FUNNEL_START,
                                    FUNNEL_STEPS)
from clickmetrics.functions.compat import ntz, pct, round_half_away, safe_ratio
from clickmetrics.operators.semi import bit_filter
from clickmetrics.operators.sessions import SESSION, TS, URL

REFERENCE_FUNNEL = FUNNEL_STEPS


def page_order_rate(wp: DataFrame, o: DataFrame, pages: Sequence[str] = BILLING_PAGES,
                    before: str | None = None) -> DataFrame:
    """M29 / M30 (``before`` = strict time cut-off on the hit): per page, its hits,
    its (order, hit) pairs joined by session, and pairs / hits (0 when no hits).

    The pair count per page equals the sum over sessions of
    ``orders(session) * hits(session, page)``; both factors are aggregated
    before the join, so no pair list is built and a session with many orders
    and hits costs one row.
    """
    h = wp.filter(F.col(URL).isin(list(pages)))
    if before is not None:
        h = h.filter(F.col(TS) < ntz(before))
    hits_by_session = h.groupBy(SESSION, URL).agg(F.count(F.lit(1)).alias("_h"))
    orders_by_session = o.groupBy(SESSION).agg(F.count(F.lit(1)).alias("_o"))
    per_page = (hits_by_session.join(orders_by_session, SESSION, "left")
                .groupBy(URL).agg(F.sum("_h").alias("total_page_views"),
                                  F.sum(F.col("_h") * F.coalesce(F.col("_o"), F.lit(0))).alias("total_orders")))
    return per_page.select(URL, "total_page_views", "total_orders",
                           safe_ratio(F.col("total_orders"), F.col("total_page_views")).alias("conversion_rate"))


def funnel(wp: DataFrame, ws: DataFrame, steps: Sequence[tuple[str, str, str]] = REFERENCE_FUNNEL,
           source: str = CAMPAIGN_SOURCE, campaign: str = CAMPAIGN_NAME,
           start: str = FUNNEL_START, end: str = FUNNEL_END, rates_only: bool = False) -> DataFrame:
    """M31 / M32 (``rates_only``): set-membership funnel over the derived table.

    Per session (campaign sessions, hits with ``start <= created_at <= end``)
    a 0/1 flag per step page; a session reaches step i if it has steps 0..i
    (in any order).  Outputs ``total_sessions``, ``<step>_page`` for steps
    after the first, and ``<rate>_click_rate`` = reached(i) / reached(i-1) *
    100, rounded to 2 (NULL when the previous step has no session).  Hits of
    other campaigns mostly go before the first exchange; the others become one
    row of flags per session before the exact campaign filter.
    """
    campaign_sessions = ws.filter((F.col("utm_source") == source) & (F.col("utm_campaign") == campaign)).select(SESSION)
    h = bit_filter(wp.filter(F.col(TS).between(ntz(start), ntz(end))), campaign_sessions, SESSION)
    flags = [F.max(F.when(F.col(URL) == F.lit(url), 1).otherwise(0)).alias(name) for name, url, _ in steps]
    per_session = h.groupBy(SESSION).agg(*flags).join(campaign_sessions, SESSION, "left_semi")

    reached = []
    prior = None
    for name, _, _ in steps:
        cond = F.col(name) if prior is None else F.when(prior, F.col(name)).otherwise(F.lit(0))
        reached.append(F.sum(cond).alias(f"{name}_page"))
        step_true = F.col(name) == 1
        prior = step_true if prior is None else (prior & step_true)
    totals = per_session.agg(F.count(SESSION).alias("total_sessions"), *reached)

    cols = [F.col("total_sessions")]
    if not rates_only:
        cols += [F.col(f"{name}_page") for name, _, _ in steps[1:]]
    for (prev, _, _), (name, _, rate) in zip(steps, steps[1:]):
        cols.append(round_half_away(pct(F.col(f"{name}_page"), F.col(f"{prev}_page")), 2).alias(f"{rate}_click_rate"))
    return totals.select(*cols)
