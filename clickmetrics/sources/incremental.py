"""Derivation by steps: ``SELECT ... INTO`` that can be run again as data arrive.

A step takes the events from the end of the step before up to ``until`` and the events of sessions that were
still open, sessionizes only those, and appends the sessions that can't grow any more (no event within
the gap before ``until``).  Its work follows the new events and the open sessions, not the history.

Layout under ``root``, one folder per step:

* ``closed/step=N``: sessionized events of the sessions that the step closed;
* ``open/step=N``: events of the sessions still open (the only ones sessionized again);
* ``counts/step=N``: closed sessions per user so far, so that session numbers go on (one narrow row per user);
* ``done/step=N``: the step's ``until``, written last.

A step that was cut off has no ``done`` row: nobody reads its folders and the next run writes them anew.
Every event must be there before its step is run: events before the last ``until`` are never looked at again.
A session that never pauses for the gap stays in ``open`` whole.  Rows without a time have no session, as in
:func:`~clickmetrics.operators.sessionize.gap_sessions`.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmetrics.functions.compat import epoch_micros, ntz
from clickmetrics.operators.joins import HOT_KEY_ROWS, hot_keys, skew_join
from clickmetrics.operators.sessionize import gap_sessions
from clickmetrics.session import path_exists

_COLUMNS = ("session_id", "session_seq", "at_session_start")


def _folder(root: str, table: str, step: int) -> str:
    return os.path.join(root, table, f"step={step}")


def steps_done(spark: SparkSession, root: str) -> list[str]:
    """``until`` of every finished step, in order (one short row per step)."""
    out = []
    while path_exists(spark, os.path.join(_folder(root, "done", len(out)), "_SUCCESS")):
        out.append(spark.read.parquet(_folder(root, "done", len(out))).first()["until"])
    return out


def _numbered(sessionized: DataFrame, counts: DataFrame | None, until: str | None, gap_seconds: int, hot_threshold: int) -> DataFrame:
    """Sessionized events with session numbers that go on from ``counts``, and ``_closed``.

    Facts per session are aggregated (map-side) and go back by a join that splits sessions above the hot limit."""
    per = sessionized.groupBy("user_id", "session_id", "session_seq").agg(F.max("ts").alias("_last"), F.count(F.lit(1)).alias("_n"))
    if counts is None:
        per = per.withColumn("closed_sessions", F.lit(0).cast("long"))
    else:
        # One row per session; at most time span / gap of them share a user.
        per = per.join(counts.withColumnRenamed("user_id", "_user"), F.col("user_id").eqNullSafe(F.col("_user")), "left").drop("_user")
    end = F.lit(False) if until is None else epoch_micros("_last") + F.lit(int(gap_seconds) * 1_000_000) < epoch_micros(ntz(until))
    facts = per.select("session_id", "_n", F.coalesce("closed_sessions", F.lit(0)).alias("_before"), end.alias("_closed"))
    hot = hot_keys(facts, ["session_id"], "_n", hot_threshold)
    rows = skew_join(sessionized, facts.drop("_n"), ["session_id"], "inner", hot=hot, spread_by=["event_id"], threshold=hot_threshold)
    return rows.withColumn("session_seq", F.col("session_seq") + F.col("_before")).drop("_before")


def derive_step(spark: SparkSession, events: DataFrame, root: str, until: str, gap_seconds: int,
                hot_threshold: int = HOT_KEY_ROWS) -> None:
    """Take in the events before ``until`` (a date or time) that no step has taken in."""
    done = steps_done(spark, root)
    step = len(done)
    if done and not done[-1] < until:
        raise ValueError(f"steps go forward: {until} after {done[-1]}")
    new = events.where(F.col("ts") < ntz(until))  # reaches the scan, like the bound below
    counts = None
    if done:
        new = new.where(F.col("ts") >= ntz(done[-1])).unionByName(spark.read.parquet(_folder(root, "open", step - 1)))
        counts = spark.read.parquet(_folder(root, "counts", step - 1))
    cols = new.columns
    flagged = _numbered(gap_sessions(new, gap_seconds, hot_threshold=hot_threshold), counts, until, gap_seconds, hot_threshold)
    both = os.path.join(root, "work", f"step={step}")
    flagged.write.mode("overwrite").partitionBy("_closed").parquet(both)  # sessionized once, read by closed or not
    flagged = spark.read.schema(flagged.schema).parquet(both)
    closed = flagged.where("_closed").drop("_closed")
    closed.write.mode("overwrite").parquet(_folder(root, "closed", step))
    flagged.where("not _closed").select(*cols).write.mode("overwrite").parquet(_folder(root, "open", step))
    fresh = closed.groupBy("user_id").agg(F.countDistinct("session_id").alias("closed_sessions"))
    if counts is not None:
        fresh = counts.unionByName(fresh).groupBy("user_id").agg(F.sum("closed_sessions").alias("closed_sessions"))
    fresh.write.mode("overwrite").parquet(_folder(root, "counts", step))
    spark.range(1).select(F.lit(until).alias("until")).write.mode("overwrite").parquet(_folder(root, "done", step))


def read_steps(spark: SparkSession, root: str, gap_seconds: int, hot_threshold: int = HOT_KEY_ROWS) -> DataFrame:
    """Sessionized events of all finished steps: closed sessions as written, open ones sessionized now."""
    done = steps_done(spark, root)
    if not done:
        raise ValueError(f"no finished step under {root}")
    last = len(done) - 1
    closed = spark.read.parquet(*[_folder(root, "closed", i) for i in range(len(done))])
    counts = spark.read.parquet(_folder(root, "counts", last))
    running = gap_sessions(spark.read.parquet(_folder(root, "open", last)), gap_seconds, hot_threshold=hot_threshold)
    running = _numbered(running, counts, None, gap_seconds, hot_threshold).drop("_closed")
    return closed.unionByName(running.select(*closed.columns))
