"""Per-session and per-user building blocks shared by the metrics.

Design rule: no window may hold a whole session or a whole user, because one
session or user can own a large share of all hits.  Per-group facts (hit
count, first time, first session) are therefore computed with aggregates,
which Spark combines map-side before the shuffle, and joined back on the key;
hits are reduced (per session, per time, or per page) before such joins, so
neither a large session nor a pile of identical copies reaches one task.
Ordered operations (the next time, ranks) range-partition the hits by session
and time, so a large session spreads over as many partitions as its share
(:mod:`clickmetrics.operators.ordered`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmetrics.functions.compat import boundary_diff
from clickmetrics.operators.joins import HOT_KEY_ROWS, hot_keys, skew_join
from clickmetrics.operators.ordered import NEXT, RANK, ordered_scan

SESSION = "website_session_id"
USER = "user_id"
TS = "created_at"
URL = "pageview_url"
HIT = "website_pageview_id"


def hits_per_session(hits: DataFrame, count_col: str | None = None, name: str = "n_hits") -> DataFrame:
    """``(session, n_hits)``: ``COUNT(*)`` (or ``COUNT(count_col)``) per session."""
    c = F.count(F.lit(1)) if count_col is None else F.count(count_col)
    return hits.groupBy(SESSION).agg(c.alias(name))


def entry_hits(hits: DataFrame) -> DataFrame:
    """Hits ranked first by time in their session (``DENSE_RANK() ... = 1``): ties are all kept.

    The session's first time is an aggregate; hits are matched to it with an
    equi-join on ``(session, time)``, so a large session is spread over tasks
    by time instead of landing in one.  As in the reference dialect, NULL
    times sort first: a session having a NULL-time hit has exactly those hits
    as entry hits.
    """
    first = hits.groupBy(SESSION).agg(
        F.min(TS).alias("_first_ts"),
        F.max(F.col(TS).isNull().cast("int")).alias("_has_null"),
    )
    firsts = first.where(F.col("_has_null") == 0).select(F.col(SESSION).alias("_fs"), F.col("_first_ts"))
    at_first = hits.join(firsts, hits[SESSION].eqNullSafe(firsts["_fs"]) & (hits[TS] == firsts["_first_ts"]), "inner")
    return at_first.drop("_fs", "_first_ts").unionByName(hits.where(F.col(TS).isNull()))


def _ids(hits: DataFrame) -> tuple[str, ...]:
    """Columns that tell hits of one session and time apart."""
    return (HIT,) if HIT in hits.columns else tuple(hits.columns)


def timed_hits(hits: DataFrame, *cols: str, key: str = SESSION, ts: str = TS, name: str = "next_ts",
               partitions: int | None = None) -> DataFrame:
    """``(key, ts, *cols, name, _entry)``: every hit with a non-NULL key and time, with ``name``, the earliest
    time of the same key that is *strictly later* (NULL for the last one), and ``_entry``, whether it is
    at the key's first time (false for all hits of a key that has a hit without time: that one ranks first).

    One exchange of the hits, by (key, time): :func:`ordered_scan`."""
    known = hits.where(F.col(key).isNotNull())
    scanned = ordered_scan(known, [key], ts, _ids(hits), partitions, keep=[key, ts, *cols])
    return scanned.where(F.col(ts).isNotNull()).select(key, ts, *cols, F.col(NEXT).alias(name), (F.col(RANK) == 1).alias("_entry"))


def next_later_time(hits: DataFrame, key: str = SESSION, ts: str = TS, name: str = "next_ts",
                    spread_by: tuple[str, ...] | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``name`` to every hit: the earliest ``ts`` of the same ``key`` that is *strictly later*.

    Equal to the reference's self-join ``LEFT JOIN hits b ON a.key = b.key AND
    a.ts < b.ts`` + ``MIN(b.ts)``, including ties (tied hits share the same
    next time), without its quadratic pair list.  Hits with a NULL key or time
    get NULL, as the join gives them no partner.  ``spread_by`` names columns
    that tell hits of one key and time apart."""
    scanned = ordered_scan(hits, [key], ts, spread_by or _ids(hits), partitions)
    return scanned.select(*hits.columns, F.when(F.col(key).isNotNull(), F.col(NEXT)).alias(name))


def hit_ranks(hits: DataFrame, partitions: int | None = None) -> DataFrame:
    """WN-2: ``DENSE_RANK() OVER (PARTITION BY session ORDER BY created_at)`` as a column of every hit."""
    scanned = ordered_scan(hits, [SESSION], TS, _ids(hits), partitions)
    return scanned.select(*hits.columns, F.col(RANK).alias("hit_rank"))


def visit_ranks(sessions: DataFrame, partitions: int | None = None) -> DataFrame:
    """WN-1: ``DENSE_RANK() OVER (PARTITION BY user_id ORDER BY website_session_id)`` of every session row."""
    scanned = ordered_scan(sessions.select(USER, SESSION), [USER], SESSION, (), partitions)
    return scanned.select(USER, SESSION, F.col(RANK).alias("visit_rank"))


def grouped_hit_ranks(hits: DataFrame, sessions: DataFrame, partitions: int | None = None) -> DataFrame:
    """WN-3: hits of ``sessions`` grouped with their next later time: page start, next start, seconds between
    and the dense rank of the hit's time in its session, all from one scan."""
    rows = hits.join(sessions.select(SESSION), SESSION, "left_semi").select(SESSION, HIT, URL, TS).distinct()
    scanned = ordered_scan(rows, [SESSION], TS, (HIT,), partitions)
    return scanned.select(SESSION, HIT, URL, F.col(TS).alias("page_start_time"), F.col(NEXT).alias("next_page_start_time"),
                          boundary_diff("SECOND", TS, NEXT).alias("time_spent_seconds"), F.col(RANK).alias("hit_rank"))


def counted_hits(hits: DataFrame, name: str = "session_hits", threshold: int = HOT_KEY_ROWS) -> DataFrame:
    """WN-4: ``COUNT(*) OVER (PARTITION BY session)`` as a column of every hit.

    Counts are combined map-side and joined back with hot sessions split, so no task holds a session
    whole.  Hits without a session are one group, as in the window; theirs is one number, and they
    aren't moved."""
    counts = hits.groupBy(SESSION).agg(F.count(F.lit(1)).alias(name))
    known = counts.where(F.col(SESSION).isNotNull())
    joined = skew_join(hits.where(F.col(SESSION).isNotNull()), known, [SESSION], "inner",
                       hot=hot_keys(known, [SESSION], name, threshold), spread_by=_ids(hits), threshold=threshold)
    lost = hits.where(F.col(SESSION).isNull())
    nulls = lost.agg(F.count(F.lit(1)).alias(name)).scalar()
    return joined.select(*hits.columns, name).unionByName(lost.withColumn(name, nulls))


def hits_at_time(hits: DataFrame, *cols: str) -> DataFrame:
    """Hits counted per ``(session, time, *cols)`` (``_c``): identical copies become one row, map-side."""
    return hits.groupBy(SESSION, TS, *cols).agg(F.count(F.lit(1)).alias("_c"))
