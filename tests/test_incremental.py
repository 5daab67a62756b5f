"""Derivation by steps gives the rows of one derivation over everything, and reads only what is new."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clickmetrics.operators.sessionize import gap_sessions
from clickmetrics.session import checkpoint_dir
from clickmetrics.sources.incremental import derive_step, read_steps, steps_done

SCHEMA = "event_id long, ts timestamp_ntz, user_id long"
COLS = ("event_id", "ts", "user_id", "session_id", "session_seq", "at_session_start")
MIDNIGHT = dt.datetime(2024, 1, 2)


def fresh(spark) -> str:
    return tempfile.mkdtemp(prefix="steps-", dir=checkpoint_dir(spark))


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*COLS).collect())))


def by_steps(spark, events, ends, gap, hot=2_000_000):
    root = fresh(spark)
    for until in ends:
        derive_step(spark, events, root, until, gap, hot)
    return read_steps(spark, root, gap, hot)


# Minutes around two midnights: sessions that cross them, exact gaps, ties at the very end of a step.
_events = st.lists(st.tuples(st.sampled_from([1, 2, None]), st.sampled_from([-90, -60, -31, -30, -1, 0, 0, 1, 29, 30, 31, 1400, 1440, 1441, 2000])),
                   max_size=14)


@settings(max_examples=4)
@given(_events, st.sampled_from([2, 2_000_000]))
def test_steps_equal_one_derivation(spark, drawn, hot):
    data = [(100 - i if i % 3 else i, MIDNIGHT + dt.timedelta(minutes=m), u) for i, (u, m) in enumerate(drawn)]
    events = spark.createDataFrame(data, SCHEMA)
    got = by_steps(spark, events, ("2024-01-02", "2024-01-03", "2024-01-04"), 1800, hot)
    assert rows(got) == rows(gap_sessions(events, 1800))


def test_steps_are_kept_apart_and_go_forward(spark):
    data = [(1, MIDNIGHT - dt.timedelta(hours=5), 1), (2, MIDNIGHT - dt.timedelta(minutes=5), 1), (3, MIDNIGHT, 1),
            (4, MIDNIGHT + dt.timedelta(hours=3), 1)]
    events = spark.createDataFrame(data, SCHEMA)
    root = fresh(spark)
    with pytest.raises(ValueError):
        read_steps(spark, root, 1800)
    derive_step(spark, events, root, "2024-01-02", 1800)
    read = lambda table, step: sorted(r["event_id"] for r in spark.read.parquet(os.path.join(root, table, f"step={step}")).collect())
    assert read("closed", 0) == [1] and read("open", 0) == [2]  # the second session can still grow
    derive_step(spark, events, root, "2024-01-03", 1800)
    assert read("closed", 1) == [2, 3, 4] and read("open", 1) == []
    assert [(r["event_id"], r["session_id"], r["session_seq"]) for r in read_steps(spark, root, 1800).orderBy("event_id").collect()] == \
        [(1, 1, 1), (2, 2, 2), (3, 2, 2), (4, 4, 3)]
    assert steps_done(spark, root) == ["2024-01-02", "2024-01-03"]
    with pytest.raises(ValueError):
        derive_step(spark, events, root, "2024-01-02", 1800)


def test_a_step_that_was_cut_off_is_run_again(spark):
    events = spark.createDataFrame([(1, MIDNIGHT, 1), (2, MIDNIGHT + dt.timedelta(days=1), 1)], SCHEMA)
    root = fresh(spark)
    events.withColumn("junk", events["event_id"]).write.parquet(os.path.join(root, "closed", "step=0"))  # no done row
    derive_step(spark, events, root, "2024-01-05", 1800)
    assert rows(read_steps(spark, root, 1800)) == rows(gap_sessions(events, 1800))


def test_registered_query_equals_oracle(spark):
    import duckdb

    import __spark_entry__ as E
    from conftest import SF0001

    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF0001}/events.parquet'")
    want = con.sql(E.oracle_sql()["src3_incremental_sessions"])
    got = E.queries()["src3_incremental_sessions"](spark, SF0001)
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
