"""Traffic counts: visits, visitors, page views, sources, organic reach.

Inputs: ``ws`` cleaned sessions, ``wp`` pageviews, ``sp`` the derived
session/pageview table, ``o`` orders.  Every function returns a DataFrame and
reads whole tables; a single global aggregate is partial-aggregated on every
executor and merged in one tiny final task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmetrics.constants import DIRECT_SEARCH
from clickmetrics.functions.compat import round_half_away, week_start
from clickmetrics.operators.distinct import count_bitmaps, distinct_counts, id_bitmaps, merge_bitmaps
from clickmetrics.sources.sink import materialize

SESSION = "website_session_id"


def total_visits(ws: DataFrame) -> DataFrame:
    """M01 ``COUNT(website_session_id)``."""
    return ws.agg(F.count(SESSION).alias("total_visit"))


def unique_visitors(ws: DataFrame) -> DataFrame:
    """``user_rows`` is the literal ``COUNT(user_id)`` (non-NULL rows; the
    DISTINCT there applies to the one-row result), ``unique_users`` the
    distinct count the label intends."""
    return distinct_counts(ws, "user_id", {"unique_users": None}, counts={"user_rows": F.col("user_id")}).select("user_rows", "unique_users")


def page_views(wp: DataFrame) -> DataFrame:
    """M03 ``COUNT(website_pageview_id)``."""
    return wp.agg(F.count("website_pageview_id").alias("page_views"))


def visits_by(ws: DataFrame, col: str = "utm_source") -> DataFrame:
    """``COUNT(user_id)`` per value of ``col`` (sessions with a known user)."""
    return ws.groupBy(col).agg(F.count("user_id").alias("count"))


def conversion_rate(o: DataFrame, ws: DataFrame) -> DataFrame:
    """Distinct orders / distinct sessions * 100, rounded to 2.

    The two one-row aggregates are combined with a scalar subquery (each is
    evaluated once), not a join.
    """
    sessions = distinct_counts(ws, SESSION, {"s": None}).select(F.col("s").cast("double"))
    rate = F.try_divide(F.col("orders").cast("double"), sessions.scalar()) * F.lit(100.0)
    return distinct_counts(o, "order_id", {"orders": None}).select(round_half_away(rate, 2).alias("conversion_rate"))


def _organic(col: str = "utm_content", label: str = DIRECT_SEARCH):
    return F.col(col) == F.lit(label)


def organic_sessions(ws: DataFrame, label: str = DIRECT_SEARCH) -> DataFrame:
    """Sessions whose ``utm_content`` is the organic label."""
    return ws.filter(_organic(label=label)).agg(F.count(SESSION).alias("organic_sessions"))


def organic_users(ws: DataFrame, label: str = DIRECT_SEARCH) -> DataFrame:
    """Distinct users of organic sessions."""
    return distinct_counts(ws.filter(_organic(label=label)), "user_id", {"organic_users": None})


def _sessions_with_hits(wp: DataFrame, ws: DataFrame, *cols: str) -> DataFrame:
    """Sessions that have a hit, with their attributes: the session grain of the
    derived table.  Hits are reduced per session (map-side) before the join."""
    return wp.groupBy(SESSION).agg(F.count(F.lit(1)).alias("_n")).join(ws.select(SESSION, *cols), SESSION, "inner")


def organic_reach(wp: DataFrame, ws: DataFrame, label: str = DIRECT_SEARCH) -> DataFrame:
    """Distinct users and sessions of organic hits in the derived table."""
    per_session = _sessions_with_hits(wp, ws, "user_id", "utm_content").filter(_organic(label=label))
    return distinct_counts(per_session, "user_id", {"organic_users": None}, counts={"organic_sessions": F.col(SESSION)})


def organic_by_device(wp: DataFrame, ws: DataFrame, top: int | None = None, label: str = DIRECT_SEARCH) -> DataFrame:
    """Organic hits per device (``COUNT(device_type)``: a NULL device counts 0);
    ``top=k`` keeps the k largest (the comment asks for the maximum)."""
    per_session = _sessions_with_hits(wp, ws, "device_type", "utm_content").filter(_organic(label=label))
    counted = F.when(F.col("device_type").isNotNull(), F.col("_n")).otherwise(F.lit(0))
    out = per_session.groupBy("device_type").agg(F.sum(counted).cast("long").alias("count"))
    if top is not None:
        out = out.orderBy(F.desc("count"), F.asc("device_type")).limit(top)
    return out


def session_reach(wp: DataFrame, ws: DataFrame, label: str = DIRECT_SEARCH) -> DataFrame:
    """Distinct non-organic sessions (``<>`` drops NULL content) and all
    sessions, among sessions with a hit."""
    per_session = _sessions_with_hits(wp, ws, "utm_content")
    return per_session.agg(
        F.count(F.when(F.col("utm_content") != F.lit(label), F.col(SESSION))).alias("non_organic_sessions"),
        F.count(SESSION).alias("all_sessions"),
    )


def paid_pages(wp: DataFrame, ws: DataFrame, label: str = DIRECT_SEARCH) -> DataFrame:
    """Distinct urls of sessions whose ``utm_content`` is not the organic label.

    Hits are reduced to distinct (session, url) pairs before the session filter.
    """
    paid = ws.filter(F.col("utm_content") != F.lit(label)).select(SESSION)
    pairs = wp.select(SESSION, "pageview_url").distinct().join(paid, SESSION, "left_semi")
    return pairs.select(F.col("pageview_url").alias("pages")).distinct()


REACH = ("users", "organic_users", "repeat_users")


def visitor_bitmaps(ws: DataFrame, label: str = DIRECT_SEARCH) -> DataFrame:
    """AG-3 / AG-5: per day of visit (``visit_day``) the bitmaps of its users, its organic users and its users with
    a repeat session, and the number of its sessions.  A table to keep: days are added by writing theirs beside it."""
    masks = {"users": None, "organic_users": _organic(label=label), "repeat_users": F.col("is_repeat_session") == 1}
    return id_bitmaps(ws.withColumn("visit_day", F.to_date("created_at")), "user_id", masks, ["visit_day"],
                      {"sessions": F.col(SESSION)})


def reach_by_period(bitmaps: DataFrame) -> DataFrame:
    """AG-6: distinct users, organic users and repeat users of every day, every week (Sundays belong to the next
    one) and of all days, and the sessions, from :func:`visitor_bitmaps` alone: a week's bitmap is the ``bit_or`` of
    its days' and all days' that of the weeks'.  ``period`` is ``day``, ``week`` or ``all`` (``starts`` NULL)."""
    masks, counts = list(REACH), ["sessions"]
    week = F.to_date(week_start(F.col("visit_day").cast("timestamp_ntz"))).alias("visit_week")
    weeks = merge_bitmaps(bitmaps, masks=masks, by=[week], counts=counts)
    everything = merge_bitmaps(weeks, masks=masks, counts=counts)
    parts = [("day", F.col("visit_day"), count_bitmaps(bitmaps, masks, ["visit_day"], counts)),
             ("week", F.col("visit_week"), count_bitmaps(weeks, masks, ["visit_week"], counts)),
             ("all", F.lit(None).cast("date"), count_bitmaps(everything, masks, [], counts))]
    rows = [df.select(F.lit(name).alias("period"), starts.alias("starts"), *counts, *masks) for name, starts, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def visitor_reach(ws: DataFrame, label: str) -> DataFrame:
    """:func:`reach_by_period` over daily bitmaps that are written once (as ``label``) and read for all periods."""
    return reach_by_period(materialize(ws.sparkSession, visitor_bitmaps(ws), label))
