"""Task balance under skew, from Spark's event log (written to a fresh scratch folder).

Moves a third of the events onto one user, then runs (a) the textbook
``lag`` window sessionization and (b) :func:`gap_sessions`, and reports, for
each, the largest share of a stage's shuffle-read records that one task
handled.  Usage: python tools/skew_report.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import sys
import tempfile
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from clickmetrics.functions.compat import epoch_micros  # noqa: E402
from clickmetrics.operators.sessionize import gap_sessions  # noqa: E402
from clickmetrics.operators.sessions import hits_per_session, next_later_time  # noqa: E402
from clickmetrics.plans.catalog import CATALOG, Prepared  # noqa: E402
from clickmetrics.sources.events import materialize_events, web_tables_from_events  # noqa: E402
from clickmetrics.sources.sink import materialize  # noqa: E402
from clickmetrics.session import get_spark  # noqa: E402
from clickmetrics.sources.events import read_events  # noqa: E402


def lag_sessions(ev, gap_seconds):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    b = ev.withColumn("nb", F.when(F.col("ts") <= F.lag("ts").over(w) + F.expr(f"INTERVAL {gap_seconds} SECONDS"), 0)
                      .otherwise(1))
    s = b.withColumn("seq", F.sum("nb").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.withColumn("sid", F.min("event_id").over(Window.partitionBy("user_id", "seq")))


def stage_shares(log_dir: str, job_group: str) -> float:
    """Largest (task shuffle-read records / stage shuffle-read records) over stages of a job group."""
    files = [f for f in glob.glob(f"{log_dir}/**/*", recursive=True) if Path(f).is_file()]
    per_stage = defaultdict(list)
    stage_group = {}
    for f in files:
        for line in open(f):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                group = (e.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in e.get("Stage IDs", []):
                    stage_group[sid] = group
            elif ev == "SparkListenerTaskEnd":
                m = e.get("Task Metrics") or {}
                recs = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                per_stage[e["Stage ID"]].append(recs)
    worst = 0.0
    for sid, recs in per_stage.items():
        if stage_group.get(sid) != job_group or sum(recs) < 1000:
            continue
        worst = max(worst, max(recs) / sum(recs))
    return worst


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="run-skew-")
    spark = get_spark("local[8]", 32, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        # Test-sized thresholds so AQE's skew-join split shows at sf0.1 (defaults are 256 MB).
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    ev = read_events(spark, sf_dir)
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    sc = spark.sparkContext
    sc.setJobGroup("lag_window", "textbook lag window")
    lag_sessions(hot, 12 * 3600).write.format("noop").mode("overwrite").save()
    sc.setJobGroup("bucketed", "bucketed gap sessions")
    gap_sessions(hot, 12 * 3600).write.format("noop").mode("overwrite").save()

    # One hot (user, 12h bucket): a third of the events onto one user inside one 12-hour window.
    burst = hot.withColumn("ts", F.when(F.col("event_id") % 3 == 0,
                                        F.timestamp_add("SECOND", F.col("event_id") % 40000,
                                                        F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")))
                           .otherwise(F.col("ts")))
    sc.setJobGroup("burst_plain", "hot user-bucket, no salt")
    gap_sessions(burst, 12 * 3600).write.format("noop").mode("overwrite").save()
    sc.setJobGroup("burst_salted", "hot user-bucket, split as a hot key")
    # Test-sized threshold (default 2e6 rows): keys with more than 2,000 events are split.
    gap_sessions(burst, 12 * 3600, hot_threshold=2000).write.format("noop").mode("overwrite").save()

    # Next hit on the resulting pageviews (the hot user's events form giant sessions).
    sc.setJobGroup("setup", "derive tables")
    raw = web_tables_from_events(hot)
    wp = materialize(spark, raw.pageviews, f"skew-report-{Path(log_dir).name}")
    biggest = wp.groupBy("website_session_id").count().agg(F.max("count")).first()[0]
    sc.setJobGroup("lead_window", "textbook lead over session")
    w = Window.partitionBy("website_session_id").orderBy(epoch_micros("created_at").desc())
    wp.withColumn("next_ts", F.min("created_at").over(w.rangeBetween(Window.unboundedPreceding, -1))) \
        .write.format("noop").mode("overwrite").save()
    sc.setJobGroup("bucketed_next", "bucketed next hit")
    next_later_time(wp).write.format("noop").mode("overwrite").save()
    # Per-session hit count attached to every hit (COUNT(*) OVER (PARTITION BY session)).
    sc.setJobGroup("count_window", "textbook count over session")
    wp.withColumn("page_count", F.count(F.lit(1)).over(Window.partitionBy("website_session_id"))) \
        .write.format("noop").mode("overwrite").save()
    sc.setJobGroup("count_join", "aggregate joined back")
    wp.join(hits_per_session(wp), "website_session_id").write.format("noop").mode("overwrite").save()
    total = wp.count()

    # Every registered plan on the skewed tables (written once).
    tables = materialize_events(spark, hot, f"skew-report-all-{Path(log_dir).name}")
    for name, plan in CATALOG.items():
        sc.setJobGroup(f"plan:{name}", name)
        plan(Prepared(tables)).write.format("noop").mode("overwrite").save()
    spark.stop()
    print(json.dumps({
        "hot_user_share": 1 / 3,
        "largest_task_share_lag_window": round(stage_shares(log_dir, "lag_window"), 4),
        "largest_task_share_bucketed": round(stage_shares(log_dir, "bucketed"), 4),
        "hot_bucket_largest_task_share_plain": round(stage_shares(log_dir, "burst_plain"), 4),
        "hot_bucket_largest_task_share_split": round(stage_shares(log_dir, "burst_salted"), 4),
        "largest_session_share_of_hits": round(biggest / total, 4),
        "next_hit_largest_task_share_session_window": round(stage_shares(log_dir, "lead_window"), 4),
        "next_hit_largest_task_share_bucketed": round(stage_shares(log_dir, "bucketed_next"), 4),
        "session_count_largest_task_share_window": round(stage_shares(log_dir, "count_window"), 4),
        "session_count_largest_task_share_aggregate_join": round(stage_shares(log_dir, "count_join"), 4),
        "plans_worst_task_share": {name: round(stage_shares(log_dir, f"plan:{name}"), 4) for name in CATALOG},
        "event_log": log_dir,
    }))


if __name__ == "__main__":
    main()
