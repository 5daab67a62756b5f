"""Invariants on the events-derived web tables (sf0.001) and random sessionization inputs."""

from __future__ import annotations

import datetime as dt

from hypothesis import given
from hypothesis import strategies as st

from clickmetrics.operators import bounce, conversion, engagement, visitors
from clickmetrics.operators.sessionize import gap_sessions
from clickmetrics.constants import FUNNEL_STEPS
from clickmetrics.plans.catalog import Prepared
from clickmetrics.sources.events import load_from_events
from conftest import SF0001, one
from test_equivalence import lag_sessions


def test_new_plus_repeat_is_all_pairs(spark):
    t = Prepared(load_from_events(spark, SF0001))
    new, rep = one(visitors.new_vs_repeat(t.ws))
    assert new + rep == t.ws.select("user_id", "website_session_id").distinct().count()


def test_funnel_counts_never_increase(spark):
    t = Prepared(load_from_events(spark, SF0001))
    r = one(conversion.funnel(t.wp, t.ws, FUNNEL_STEPS, start="2024-01-01", end="2024-01-31"))
    counts = list(r[1:len(FUNNEL_STEPS)])
    assert all(a >= b for a, b in zip(counts, counts[1:]))
    assert r[0] >= counts[0]


def test_bounced_never_exceeds_total(spark):
    t = Prepared(load_from_events(spark, SF0001))
    for r in bounce.weekly_page_trend(t.wp, t.ws, start="2024-01-01", end="2024-01-31").collect():
        assert 0 <= r.bounced_sessions <= r.total_sessions
    for r in bounce.page_ab_test(t.wp, t.ws).collect():
        assert 0 <= r.bounced_sessions <= r.total_sessions


def test_entry_hits_at_least_sessions(spark):
    t = Prepared(load_from_events(spark, SF0001))
    entries = sum(r["count"] for r in engagement.entry_pages(t.wp).collect())
    assert entries >= t.wp.select("website_session_id").distinct().count()


_events = st.lists(
    st.tuples(st.integers(0, 3), st.integers(0, 48 * 3600)),  # user, second offset within two days
    min_size=1, max_size=25)


@given(_events, st.sampled_from([1800, 3600, 12 * 3600]), st.sampled_from([1, 3, 2_000_000]))
def test_sessionization_matches_lag_window(spark, evs, gap, hot):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=s), u) for i, (u, s) in enumerate(evs)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long")
    ours = gap_sessions(ev, gap, hot_threshold=hot)
    ref = lag_sessions(ev, gap)
    assert sorted((r.event_id, r.session_id) for r in ours.collect()) == sorted((r.event_id, r.sid) for r in ref.collect())


_T0 = dt.datetime(2024, 1, 1, 9, 59, 59)
# Offsets (microseconds) that straddle second, hour and day boundaries; repeats make ties.
_OFFSETS = [0, 1, 999_999, 1_000_000, 1_000_001, 3_599_999_999, 3_600_000_000, 3_600_000_001,
            7_200_000_000, 86_400_000_000, 90_000_000_000]
_hits = st.lists(
    st.tuples(st.sampled_from([1, 2, 3, None]),                      # session (NULL too)
              st.one_of(st.none(), st.sampled_from(_OFFSETS)),       # time (NULL too)
              st.sampled_from(["/a", "/b", None])),                  # url
    min_size=1, max_size=20)


def _hits_df(spark, hs):
    rows = [(i, None if off is None else _T0 + dt.timedelta(microseconds=off), s, u) for i, (s, off, u) in enumerate(hs)]
    return spark.createDataFrame(rows, "website_pageview_id long, created_at timestamp_ntz, "
                                       "website_session_id long, pageview_url string")


@given(_hits)
def test_next_time_matches_self_join(spark, hs):
    from clickmetrics.operators.sessions import next_later_time
    from test_equivalence import literal_next

    hits = _hits_df(spark, hs)
    ours = sorted(tuple(r) for r in next_later_time(hits).select("website_pageview_id", "next_ts").collect())
    ref = sorted(tuple(r) for r in literal_next(spark, hits).collect())
    assert ours == ref


@given(_hits)
def test_entry_hits_match_dense_rank(spark, hs):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from clickmetrics.operators.sessions import entry_hits

    hits = _hits_df(spark, hs)
    ours = sorted(r[0] for r in entry_hits(hits).select("website_pageview_id").collect())
    w = Window.partitionBy("website_session_id").orderBy(F.col("created_at").asc_nulls_first())
    ref = sorted(r[0] for r in hits.withColumn("dr", F.dense_rank().over(w)).filter("dr = 1")
                 .select("website_pageview_id").collect())
    assert ours == ref


_pairs = st.lists(st.tuples(st.sampled_from([0, 1, 2, None]), st.integers(0, 5)), min_size=0, max_size=30)


@given(_pairs, _pairs, st.sampled_from([1, 2, 5]), st.sampled_from(["inner", "left"]))
def test_skew_join_matches_plain_join(spark, big_rows, small_rows, threshold, how):
    from clickmetrics.operators.joins import skew_join

    big = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(big_rows)], "id long, k long, v long")
    small = spark.createDataFrame(small_rows, "k long, w long")
    plain = sorted(map(repr, (tuple(r) for r in big.join(small, ["k"], how).select("id", "k", "v", "w").collect())))
    split = sorted(map(repr, (tuple(r) for r in skew_join(big, small, ["k"], how, spread_by=["id"], threshold=threshold,
                                                          ).select("id", "k", "v", "w").collect())))
    assert split == plain
