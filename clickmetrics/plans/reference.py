"""The analyses with the reference's own parameters, for a user's own web tables.

:data:`clickmetrics.plans.catalog.CATALOG` passes dates that fall inside the
test data.  Here every plan uses the operators' defaults, which are the
reference literals: the 2012 date ranges, the 2012-10-10 cut-off and the
seven-step funnel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickmetrics.constants import BILLING_CUTOFF, FUNNEL_END, FUNNEL_START, TREND_END, TREND_START
from clickmetrics.operators import bounce, conversion
from clickmetrics.plans.catalog import CATALOG, Plan, Prepared
from clickmetrics.sources.tables import load_web_tables

REFERENCE_ORDER_CUTOFF = BILLING_CUTOFF



def _browsed(name: str) -> Plan:
    def plan(t: Prepared) -> DataFrame:
        df = getattr(t.raw, name)
        if df is None:
            raise ValueError(f"there is no table {name}")
        return df

    return plan


REFERENCE_PLANS: dict[str, Plan] = dict(CATALOG)
REFERENCE_PLANS.update({
    "m27_weekly_trend": lambda t: bounce.weekly_page_trend(t.raw.hits(TREND_START, TREND_END), t.ws),
    "m30_billing_test_cutoff": lambda t: conversion.page_order_rate(t.raw.hits(end=REFERENCE_ORDER_CUTOFF), t.o, before=REFERENCE_ORDER_CUTOFF),
    "m31_funnel": lambda t: conversion.funnel(t.raw.hits(FUNNEL_START, FUNNEL_END), t.ws),
    "m32_funnel_rates": lambda t: conversion.funnel(t.raw.hits(FUNNEL_START, FUNNEL_END), t.ws, rates_only=True),
})

# D3: the two tables that are only browsed, with whatever columns their files have, where there are such tables.
BROWSE_PLANS: dict[str, Plan] = {f"d3_{name}": _browsed(name) for name in ("products", "order_item_refunds")}
ALL_PLANS: dict[str, Plan] = REFERENCE_PLANS | BROWSE_PLANS


def run_on_tables(name: str, spark: SparkSession, root: str, fmt: str = "parquet", dated: bool = False, collate: bool = False) -> DataFrame:
    """Run analysis ``name`` with reference parameters on ``root/<table>.<fmt>``
    (``website_sessions``, ``website_pageviews``, ``orders``, ``order_items``); ``dated`` as in :func:`load_web_tables`,
    ``collate``: text compares as on the reference's server (:meth:`WebTables.collated`)."""
    tables = load_web_tables(spark, root, fmt, dated)
    return ALL_PLANS[name](Prepared(tables.collated() if collate else tables))
