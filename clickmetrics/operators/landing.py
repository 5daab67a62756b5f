"""Landing pages: time on the landing page and the page scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmetrics.constants import DIRECT_SEARCH, GOAL_PAGE
from clickmetrics.functions.compat import boundary_diff, int_avg, pct, round_half_away
from clickmetrics.operators.sessions import SESSION, TS, URL, timed_hits

def landing_time(wp: DataFrame, ws: DataFrame, by: str | None = None, label: str = DIRECT_SEARCH) -> DataFrame:
    """M16 (``by=None``) / M17 (``by='pageview_url'``): average seconds from a paid
    session's first hit(s) to its next strictly later hit, as an integer
    average, then / 60.0 and rounded to 2.  Entry hits without a next hit
    are left out (so are sessions with a NULL-time hit: those hits rank
    first and have no next hit).

    Entry hits and next times come from :func:`timed_hits`; only the entry
    rows, a few per session, meet the paid sessions.
    """
    paid = ws.filter(F.col("utm_content") != F.lit(label)).select(SESSION)
    entries = timed_hits(wp, URL).where(F.col("_entry") & F.col("next_ts").isNotNull())
    e = (entries.join(paid, SESSION, "left_semi")
         .select(URL, boundary_diff("SECOND", TS, "next_ts").alias("_secs")))
    value = round_half_away(int_avg("_secs").cast("double") / F.lit(60.0), 2).alias("avg_landing_min")
    if by is None:
        return e.agg(value)
    return e.groupBy(F.col(by).alias(by)).agg(value)


def page_scorecard(wp: DataFrame, ws: DataFrame, goal: str = GOAL_PAGE) -> DataFrame:
    """Per url of hits with a known session:

    * ``view_count``: hits with a non-NULL user;
    * ``avg_time_on_page``: integer mean of the hit's minute of day (what the
      reference computes under this name; not a duration);
    * ``single_page_sessions``: one-hit sessions whose only hit is this url;
    * ``bounce_rate``: that count / all sessions with a hit, * 100;
    * ``conversion_rate``: sum over the url's hits of the session's goal flag /
      distinct sessions of the url, * 100 (the flag is summed at hit grain, as
      there, so it can exceed 100).

    Hits are first reduced to one row per (session, url) (map-side); the
    per-session facts come from those rows, and the url aggregate from their
    join.  The all-sessions total is a scalar subquery, not a join.
    """
    minute_of_day = F.hour(TS) * 60 + F.minute(TS)
    su = (wp.groupBy(SESSION, URL).agg(F.count(F.lit(1)).alias("_h"),
                                       F.sum(minute_of_day).alias("_mod_sum"),
                                       F.count(minute_of_day).alias("_mod_n"))
          .join(ws.select(SESSION, "user_id"), SESSION, "inner"))
    per_session = su.groupBy(SESSION).agg(
        F.sum("_h").alias("_n"),
        F.coalesce(F.max((F.col(URL) == F.lit(goal)).cast("int")), F.lit(0)).alias("_conv"),
    )
    all_sessions = per_session.agg(F.count(SESSION).alias("_all")).scalar()
    j = su.where(F.col(URL).isNotNull()).join(per_session, SESSION, "inner")
    per_url = j.groupBy(URL).agg(
        F.sum(F.when(F.col("user_id").isNotNull(), F.col("_h")).otherwise(F.lit(0))).alias("view_count"),
        F.expr("sum(`_mod_sum`) div nullif(sum(`_mod_n`), 0)").alias("avg_time_on_page"),
        F.sum(F.when(F.col("_n") == 1, F.col("_h")).otherwise(F.lit(0))).alias("single_page_sessions"),
        F.sum(F.col("_h") * F.col("_conv")).alias("_conversions"),
        F.count(SESSION).alias("_sessions"),
    )
    # A NULL url is dropped: the reference joins the page aggregate back on url.
    return per_url.select(
        URL, "view_count", "avg_time_on_page", "single_page_sessions",
        pct(F.col("single_page_sessions"), all_sessions).alias("bounce_rate"),
        pct(F.col("_conversions"), F.col("_sessions")).alias("conversion_rate"),
    ).orderBy(F.desc("view_count"), F.asc(URL))
