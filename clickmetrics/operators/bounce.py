"""Bounce rates.

A bounce is a one-hit session.  The reference divides by different
denominators in different statements; each function keeps its own:

* M15 / M23 :func:`bounce_rate`: one-hit sessions / *hits* (of known sessions);
* M24 :func:`bounce_by_page`: one-hit sessions on a page / the page's hits;
* M25-M27: one-hit sessions having the page / sessions having the page
  (where "having" means *any* hit of the session, not only its first).

Per-session facts (hit count, which pages) are aggregates keyed by session;
per-page results aggregate those.  Every step is partial-aggregated before
its shuffle, so a hot session or page never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickmetrics.constants import (CAMPAIGN_NAME, CAMPAIGN_SOURCE, DIRECT_SEARCH, HOME_LABEL, HOME_PAGE,
                                    LANDER_LABEL, LANDER_PAGE, TREND_END, TREND_START)
from clickmetrics.functions.compat import ntz, pct, pct_scaled_first, round_half_away, week_start
from clickmetrics.operators.semi import bit_filter
from clickmetrics.operators.sessions import SESSION, TS, URL, hits_per_session


def paid(label: str = DIRECT_SEARCH) -> Column:
    """Hits or sessions of paid traffic: ``utm_content <> label`` (NULL content is neither)."""
    return F.col("utm_content") != F.lit(label)


def bounce_rate(wp: DataFrame, ws: DataFrame, where: Column | None = None, digits: int = 2) -> DataFrame:
    """M15 (``where=paid()``, 2 digits) / M23 (no filter, 0 digits) over the derived
    table: one-hit sessions divided by *hits*, times 100.

    ``where`` is a predicate on session attributes; hits are counted per
    session before they meet the (filtered) sessions table.
    """
    sessions = ws if where is None else ws.filter(where)
    per_session = (hits_per_session(wp, SESSION, "_n")
                   .join(sessions.select(SESSION), SESSION, "left_semi"))
    return per_session.agg(
        round_half_away(pct(F.count(F.when(F.col("_n") == 1, F.lit(1))), F.sum("_n")), digits).alias("bounce_rate"))


def bounce_by_page(wp: DataFrame, ws: DataFrame) -> DataFrame:
    """Per url, hits of one-hit sessions / the url's hits (both over hits of
    known sessions), times 100, rounded to 2.  Urls without any bounce are
    absent (inner join), as in the reference.

    Hits are counted per (session, url), map-side combined; each row meets
    its session's total once, and one aggregate per url gives both counts.
    A NULL url has no bounced hits, so ``bounced > 0`` drops it too.
    """
    su = (wp.groupBy(SESSION, URL).agg(F.count(F.lit(1)).alias("_h"))
          .join(ws.select(SESSION), SESSION, "left_semi"))
    per_session = su.groupBy(SESSION).agg(F.sum("_h").alias("_n"))
    named = F.col(URL).isNotNull()
    per_url = su.join(per_session, SESSION, "inner").groupBy(URL).agg(
        F.sum(F.when(named, F.col("_h")).otherwise(F.lit(0))).alias("_t"),
        F.sum(F.when(named & (F.col("_n") == 1), F.col("_h")).otherwise(F.lit(0))).alias("_b"),
    )
    return per_url.where(F.col("_b") > 0).select(
        URL, round_half_away(pct(F.col("_b"), F.col("_t")), 2).alias("bounce_rate"))


def _arm_counts(per_session: DataFrame, arms: dict[str, str]) -> DataFrame:
    """One row per arm (in the given order) from per-session ``_n`` and ``_has_i`` flags.

    The global aggregate yields one row; ``stack`` turns it into one row per
    arm, so an arm with no session still appears (0, 0, NULL) as the
    reference's UNION ALL of per-arm aggregates does.
    """
    aggs = []
    for i, _ in enumerate(arms):
        has = F.col(f"_has{i}")
        aggs.append(F.count(F.when(has, F.lit(1))).alias(f"_t{i}"))
        aggs.append(F.count(F.when(has & (F.col("_n") == 1), F.lit(1))).alias(f"_b{i}"))
    one = per_session.agg(*aggs)
    parts = ", ".join(f"'{label.replace(chr(39), chr(39) * 2)}', _t{i}, _b{i}" for i, label in enumerate(arms))
    rows = one.selectExpr(f"stack({len(arms)}, {parts}) AS (landing_page, total_sessions, bounced_sessions)")
    return rows.withColumn("bounce_rate", pct(F.col("bounced_sessions"), F.col("total_sessions")))


def page_bounce(wp: DataFrame, page: str = HOME_PAGE, label: str = HOME_LABEL) -> DataFrame:
    """Sessions with a hit on ``page``, how many of them are one-hit sessions, and the rate."""
    per_session = wp.where(F.col(SESSION).isNotNull()).groupBy(SESSION).agg(
        F.count("website_pageview_id").alias("_n"),
        F.max((F.col(URL) == F.lit(page)).cast("int")).alias("_has_i"),
    ).select("_n", (F.col("_has_i") == 1).alias("_has0"))
    return _arm_counts(per_session, {label: page})


def page_ab_test(wp: DataFrame, ws: DataFrame, pages: dict[str, str] | None = None,
                 source: str = CAMPAIGN_SOURCE, campaign: str = CAMPAIGN_NAME) -> DataFrame:
    """Landing-page test, one row per arm: campaign sessions having the arm's
    page, those with a single hit (counted over *all* their hits), and the rate.

    Hits of other sessions mostly go before the first exchange (:func:`bit_filter`); the others are
    reduced to one row of flags per session before the exact campaign semi join.
    """
    pages = pages or {HOME_LABEL: HOME_PAGE, LANDER_LABEL: LANDER_PAGE}
    campaign_sessions = ws.filter((F.col("utm_source") == source) & (F.col("utm_campaign") == campaign)).select(SESSION)
    flags = [F.max((F.col(URL) == F.lit(url)).cast("int")).alias(f"_f{i}") for i, url in enumerate(pages.values())]
    per_session = (bit_filter(wp, campaign_sessions, SESSION)
                   .groupBy(SESSION).agg(F.count("website_pageview_id").alias("_n"), *flags)
                   .join(campaign_sessions, SESSION, "left_semi"))
    per_session = per_session.select("_n", *[(F.col(f"_f{i}") == 1).alias(f"_has{i}") for i in range(len(pages))])
    return _arm_counts(per_session, pages)


def weekly_page_trend(wp: DataFrame, ws: DataFrame, pages: tuple[str, ...] = (HOME_PAGE, LANDER_PAGE),
                      source: str = CAMPAIGN_SOURCE, campaign: str = CAMPAIGN_NAME,
                      start: str = TREND_START, end: str = TREND_END) -> DataFrame:
    """Weekly campaign traffic per page with bounce rate.

    Hits are filtered to ``start <= created_at <= end`` (inclusive; text dates
    mean midnight) *before* counting hits per session, so a session crossing
    the range edge counts only its hits inside.  Weeks start on Monday,
    Sundays belonging to the next week.  Hits of other campaigns mostly go
    before the first exchange (:func:`bit_filter`).  One map-side-combined
    aggregate per session gives its hit count and the set of its (page, week)
    pairs, which has at most ``pages`` x weeks of the range members.
    """
    campaign_sessions = ws.filter((F.col("utm_campaign") == campaign) & (F.col("utm_source") == source)).select(SESSION)
    h = bit_filter(wp.filter(F.col(TS).between(ntz(start), ntz(end))), campaign_sessions, SESSION)
    # Pages by their place in ``pages``: a set can't hold collated text.
    page = F.coalesce(*[F.when(F.col(URL) == F.lit(p), F.lit(i)) for i, p in enumerate(pages, 1)])
    seen = F.when(page.isNotNull(), F.struct(week_start(TS).alias("week_start_date"), page.alias("_page")))
    per_session = (h.groupBy(SESSION).agg(F.count(F.lit(1)).alias("_page_count"), F.collect_set(seen).alias("_seen"))
                   .join(campaign_sessions, SESSION, "left_semi"))
    per = per_session.select(SESSION, "_page_count", F.inline("_seen"))
    out = per.groupBy("week_start_date", "_page").agg(
        F.count(SESSION).alias("total_sessions"),
        F.count(F.when(F.col("_page_count") == 1, F.col(SESSION))).alias("bounced_sessions"),
    )
    name = F.element_at(F.array(*[F.lit(p) for p in pages]), F.col("_page"))
    return (out.select("week_start_date", name.alias("entry_page"), "total_sessions", "bounced_sessions",
                       pct_scaled_first(F.col("bounced_sessions"), F.col("total_sessions")).alias("bounce_rate"))
            .orderBy("week_start_date", "entry_page"))
