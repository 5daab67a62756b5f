"""Rewrites equal the reference's literal forms: next-hit self-join, lag-window
sessionization, UNION ALL A/B test, cross-joined scalar ratios."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickmetrics.operators import bounce
from clickmetrics.operators.sessionize import gap_sessions, sessions_of
from clickmetrics.operators.sessions import timed_hits, next_later_time
from clickmetrics.sources.events import read_events
from conftest import SF0001


def literal_next(spark, hits):
    hits.createOrReplaceTempView("h_lit")
    return spark.sql("""
        SELECT a.website_pageview_id, MIN(b.created_at) AS next_ts
        FROM h_lit a LEFT JOIN h_lit b
          ON a.website_session_id = b.website_session_id AND a.created_at < b.created_at
        GROUP BY a.website_pageview_id""")


def _pairs(df):
    return sorted((r[0], r[1]) for r in df.collect())


def test_next_event_equals_self_join_golden(spark, golden):
    ours = next_later_time(golden.pageviews).select("website_pageview_id", "next_ts")
    assert _pairs(ours) == _pairs(literal_next(spark, golden.pageviews))


def test_next_event_crosses_second_and_hour_buckets(spark):
    # Ties, same-second neighbours, gaps across seconds, hours and days, NULL time and session.
    base = dt.datetime(2024, 1, 1, 10, 59, 59)
    rnd = random.Random(7)
    data = []
    pid = 0
    for s in range(6):
        t = base
        for _ in range(rnd.randint(1, 12)):
            t = t + dt.timedelta(microseconds=rnd.choice([0, 1, 250_000, 999_999, 1_000_000, 3_599_000_000, 86_400_000_000]))
            pid += 1
            data.append((pid, t, s, "/p"))
    data += [(pid + 1, None, 0, "/p"), (pid + 2, base, None, "/p")]
    hits = spark.createDataFrame(data, "website_pageview_id long, created_at timestamp_ntz, website_session_id long, pageview_url string")
    ours = next_later_time(hits).select("website_pageview_id", "next_ts")
    assert _pairs(ours) == _pairs(literal_next(spark, hits))


def lag_sessions(events, gap_seconds):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    b = events.withColumn("nb", F.when(F.col("ts") <= F.lag("ts").over(w) + F.expr(f"INTERVAL {gap_seconds} SECONDS"), 0).otherwise(1))
    s = b.withColumn("seq", F.sum("nb").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.withColumn("sid", F.min("event_id").over(Window.partitionBy("user_id", "seq")))


def test_bucketed_sessionization_equals_lag_window_on_events(spark):
    ev = read_events(spark, SF0001)
    ours = gap_sessions(ev, 12 * 3600)
    ref = lag_sessions(ev, 12 * 3600)
    a = sorted((r.event_id, r.session_id, r.session_seq) for r in ours.collect())
    b = sorted((r.event_id, r.sid, r.seq) for r in ref.collect())
    assert a == b


@pytest.mark.parametrize("gap", [60, 3600])
def test_bucketed_sessionization_exact_gap_edges(spark, gap):
    # Events exactly `gap` apart stay in one session; gap + 1 microsecond splits.
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    us = dt.timedelta(microseconds=1)
    g = dt.timedelta(seconds=gap)
    rows = [
        (1, t0, 1), (2, t0 + g, 1), (3, t0 + 2 * g + us, 1), (4, t0 + 2 * g + us, 1),  # tie
        (5, t0 + 5 * g, 1), (6, t0 + 5 * g + g - us, 1),
        (7, t0, 2), (8, t0 + g / 2, 2), (9, t0 + 3 * g / 2 + us, 2),
        (10, t0, None), (11, t0 + 3 * g, None),
    ]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long")
    ours = gap_sessions(ev, gap)
    sess = sessions_of(ours)
    ref = lag_sessions(ev, gap)
    a = sorted((r.event_id, r.session_id, r.session_seq) for r in ours.collect())
    b = sorted((r.event_id, r.sid, r.seq) for r in ref.collect())
    assert a == b
    assert sess.count() == len({(x[1]) for x in a})


def test_ab_test_counts(prepared):
    """Arms counted in plain Python: campaign sessions that saw the page, and those with one hit in all."""
    campaign = {r["website_session_id"] for r in prepared.ws.collect()
                if (r["utm_source"], r["utm_campaign"]) == ("gsearch", "nonbrand")}
    pages = {}
    for r in prepared.wp.collect():
        pages.setdefault(r["website_session_id"], []).append(r["pageview_url"])
    want = []
    for label, url in (("Home", "/home"), ("Lander-1", "/lander-1")):
        seen = [v for k, v in pages.items() if k in campaign and url in v]
        single = sum(len(v) == 1 for v in seen)
        want.append((label, len(seen), single, single / len(seen) * 100))
    assert [tuple(r) for r in bounce.page_ab_test(prepared.wp, prepared.ws).collect()] == want


def test_skew_split_sessionization_is_identical(spark):
    ev = read_events(spark, SF0001)
    cols = ("event_id", "session_id", "session_seq")
    plain = sorted(tuple(r) for r in gap_sessions(ev, 12 * 3600).select(*cols).collect())
    # threshold 2: most (user, bucket) keys are "hot" and get split
    split = sorted(tuple(r) for r in gap_sessions(ev, 12 * 3600, hot_threshold=2).select(*cols).collect())
    assert plain == split


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_plain_join(spark, how):
    from clickmetrics.operators.joins import skew_join

    big = spark.createDataFrame([(i, i % 3 if i % 7 else None, f"v{i}") for i in range(60)], "id long, k long, v string")
    small = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (None, "n"), (5, "z")], "k long, w string")
    plain = sorted(tuple(r) for r in big.join(small, ["k"], how).select("id", "k", "v", "w").collect())
    split = sorted(tuple(r) for r in skew_join(big, small, ["k"], how, spread_by=["id"], threshold=3)
                   .select("id", "k", "v", "w").collect())
    assert split == plain


def test_skew_split_row_level_outputs_are_identical(spark, golden):
    from clickmetrics.operators.prepare import session_pageviews

    hits = golden.pageviews
    a = sorted(tuple(r) for r in next_later_time(hits).select("website_pageview_id", "next_ts").collect())
    b = sorted(tuple(r) for r in next_later_time(hits, spread_by=("website_pageview_id",), partitions=17)
               .select("website_pageview_id", "next_ts").collect())
    assert a == b
    p1 = sorted(tuple(r) for r in session_pageviews(hits, golden.sessions).collect())
    p2 = sorted(tuple(r) for r in session_pageviews(hits, golden.sessions, hot_threshold=1).collect())
    assert p1 == p2 and len(p1) == 23


def test_sessionization_with_string_users(spark):
    ev = read_events(spark, SF0001)
    as_text = ev.withColumn("user_id", F.when(F.col("user_id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    ours = sorted((r.event_id, r.session_id, r.session_seq) for r in gap_sessions(as_text, 3600).collect())
    ref = sorted((r.event_id, r.sid, r.seq) for r in lag_sessions(as_text, 3600).collect())
    assert ours == ref


def test_timed_hits_of_one_partition_equal_those_of_many(golden):
    hits = golden.pageviews
    cols = ["website_session_id", "created_at", "pageview_url", "next_ts", "_entry"]
    plain = sorted(map(repr, (tuple(r) for r in timed_hits(hits, "pageview_url", partitions=1).select(*cols).collect())))
    many = sorted(map(repr, (tuple(r) for r in timed_hits(hits, "pageview_url", partitions=40).select(*cols).collect())))
    assert plain and many == plain
