"""Gap-based sessionization that stays balanced when one user owns a large share of events.

Rule: per user, ordered by ``(ts, tiebreak)``, an event starts a new session
unless ``ts <= previous ts + gap``.

The textbook plan is ``lag(ts) over (partition by user order by ts)``, which
puts every event of a user into one task; a single heavy user then becomes a
single huge task.  This operator avoids any window over raw events:

* Cut time into buckets of width ``gap``.  Inside a bucket all events lie
  within ``gap`` of each other, so only the *first* event of a
  ``(user, bucket)`` can start a session.  It does so iff the previous
  bucket ``b-1`` is empty or its last event is more than ``gap`` earlier
  (an event two buckets back is always more than ``gap`` earlier).
* So the decision needs only per-``(user, bucket)`` aggregates
  (``min`` / ``max``), which Spark pre-aggregates map-side: no group is
  ever collected whole.
* The ordered scan (lag, running count of session starts) runs over those
  aggregates, one row per non-empty bucket of a user: at most
  ``time span / gap`` rows per user, independent of the event count.
* Events get their session through an equi-join on ``(user, bucket)``, a
  skew join that splits hot keys by their counted rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickmetrics.functions.compat import epoch_micros, floor_div
from clickmetrics.operators.joins import HOT_KEY_ROWS, hot_keys, skew_join


def gap_sessions(events: DataFrame, gap_seconds: int, user: str = "user_id", ts: str = "ts",
                 tiebreak: str = "event_id", hot_threshold: int = HOT_KEY_ROWS) -> DataFrame:
    """Assign sessions to events.

    Returns the input columns plus ``session_id`` (smallest ``tiebreak`` value
    of the session), ``session_seq`` (1, 2, ... per user) and
    ``at_session_start`` (true on the events at the session's first instant;
    more than one only if several events share it).  One row per session is
    :func:`sessions_of`.

    All aggregates hold fixed-width longs (``min`` / ``max``), so Spark plans
    hash aggregation with map-side combining.

    The final event -> session join is a :func:`~clickmetrics.operators.joins.skew_join`:
    a (user, bucket) with more than ``hot_threshold`` events (known from the
    bucket aggregate, no extra pass) is spread over several tasks.
    """
    gap_us = int(gap_seconds) * 1_000_000
    ev = events.withColumn("_us", epoch_micros(ts)).withColumn("_bucket", floor_div(F.col("_us"), gap_us))

    buckets = ev.groupBy(user, "_bucket").agg(
        F.min("_us").alias("_first_us"),
        F.max("_us").alias("_last_us"),
        F.min(tiebreak).alias("_min_id"),
        F.count(F.lit(1)).alias("_n"),
    )

    w_user = Window.partitionBy(user).orderBy("_bucket")
    prev_bucket = F.lag("_bucket").over(w_user)
    prev_last = F.lag("_last_us").over(w_user)
    starts = (prev_bucket.isNull()
              | (prev_bucket != F.col("_bucket") - 1)
              | (F.col("_first_us") > prev_last + F.lit(gap_us)))
    buckets = buckets.withColumn("_starts", starts.cast("int"))
    buckets = buckets.withColumn(
        "session_seq", F.sum("_starts").over(w_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))

    # Session-level values; the window keys (user, seq) are already clustered by user: no new shuffle.
    w_sess = Window.partitionBy(user, "session_seq")
    mapping = buckets.select(
        F.col(user).alias("_m_user"), F.col("_bucket").alias("_m_bucket"), "session_seq",
        F.min("_min_id").over(w_sess).alias("session_id"),
        F.min("_first_us").over(w_sess).alias("_start_us"),
    )
    # Null-safe join keys: a NULL user is one group, as in the window formulation.
    def keyed(df: DataFrame, u: str, b: str) -> DataFrame:
        dtype = df.schema[u].dataType
        placeholder = F.lit("") if isinstance(dtype, T.StringType) else F.lit(0).cast(dtype)
        return (df.withColumn("_k1", F.coalesce(F.col(u), placeholder))
                  .withColumn("_k2", F.col(u).isNull())
                  .withColumn("_k3", F.col(b)))

    keys = ["_k1", "_k2", "_k3"]
    hot = hot_keys(keyed(buckets, user, "_bucket"), keys, "_n", hot_threshold)
    joined = skew_join(keyed(ev, user, "_bucket"), keyed(mapping, "_m_user", "_m_bucket").drop("_m_user", "_m_bucket"),
                       keys, "inner", hot=hot, spread_by=[tiebreak], threshold=hot_threshold)
    return (joined.withColumn("at_session_start", F.col("_us") == F.col("_start_us"))
            .drop(*keys, "_us", "_bucket", "_start_us"))


def sessions_of(sessionized: DataFrame, user: str = "user_id", ts: str = "ts", tiebreak: str = "event_id",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per session from :func:`gap_sessions` output: ``user``,
    ``session_id``, ``session_seq``, ``session_start`` and, for each name in
    ``carry``, ``first_<name>``: its value on the first event in
    ``(ts, tiebreak)`` order.  Only the events at the session's first instant
    are aggregated (about one per session).
    """
    return sessionized.filter(F.col("at_session_start")).groupBy(user, "session_id", "session_seq").agg(
        F.min(ts).alias("session_start"),
        *[F.min_by(c, tiebreak).alias(f"first_{c}") for c in carry],
    )
