"""Engagement: session duration, pages per session, time on page, top and entry pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmetrics.functions.compat import boundary_diff, int_avg, round_half_away
from clickmetrics.operators.sessions import SESSION, TS, URL, entry_hits, hits_at_time, timed_hits


def avg_session_minutes(wp: DataFrame, ws: DataFrame) -> DataFrame:
    """M04 over the derived table (hits of known sessions): per session
    ``DATEDIFF(MINUTE, MIN(t), MAX(t))`` (boundaries crossed), then the integer
    average over sessions; one-hit sessions count 0.

    Hits are reduced to one row per session before meeting the sessions table.
    """
    per_session = wp.groupBy(SESSION).agg(F.min(TS).alias("_s"), F.max(TS).alias("_e"))
    per_session = per_session.join(ws.select(SESSION), SESSION, "left_semi")
    per_session = per_session.select(boundary_diff("MINUTE", "_s", "_e").alias("_m"))
    return per_session.agg(int_avg("_m").alias("avg_session_minutes"))


def pages_per_session(wp: DataFrame) -> DataFrame:
    """Url count per session; integer average and maximum over sessions."""
    per_session = wp.groupBy(SESSION).agg(F.count(URL).alias("_n"))
    return per_session.agg(int_avg("_n").alias("avg_pages"), F.max("_n").alias("max_pages"))


def time_on_page(wp: DataFrame) -> DataFrame:
    """Seconds from each hit to the session's next strictly later hit
    (boundary seconds), summed per url, / 60.0, divided by *all* hits of the
    url (exits and hits without session or time included), rounded to 1.  A
    url with only exits gives NULL.

    The seconds come from :func:`timed_hits`; the per-url hit counts are a separate
    map-side-combined aggregate; the two meet as one row per url.
    """
    t = timed_hits(wp, URL)
    secs = boundary_diff("SECOND", TS, "next_ts")
    sums = t.groupBy(URL).agg((F.sum(secs).cast("double") / F.lit(60.0)).alias("_mins"))
    counts = wp.groupBy(URL).agg(F.count(URL).alias("_n"))
    per_url = counts.join(sums, URL, "left")
    return per_url.select(URL, round_half_away(F.try_divide(F.col("_mins"), F.col("_n").cast("double")), 1)
                          .alias("time_on_page_min"))


def top_pages(wp: DataFrame, n: int | None = None) -> DataFrame:
    """Hits per url, most viewed first; ``n`` keeps the top n (a top-k report)."""
    out = wp.groupBy(URL).agg(F.count(URL).alias("count")).orderBy(F.desc("count"), F.asc(URL))
    return out.limit(n) if n is not None else out


def entry_pages(wp: DataFrame) -> DataFrame:
    """First hit(s) of each session by time (ties kept), counted per url, most first."""
    e = entry_hits(hits_at_time(wp, URL))
    named = F.when(F.col(URL).isNotNull(), F.col("_c")).otherwise(F.lit(0))
    return e.groupBy(URL).agg(F.sum(named).cast("long").alias("count")).orderBy(F.desc("count"), F.asc(URL))
