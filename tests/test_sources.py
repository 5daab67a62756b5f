"""Sources and sinks: CSV keeps the text 'NULL', Parquet round trip, schema checks, materialization."""

from __future__ import annotations

import os
import tempfile

import pytest

from clickmetrics.operators import traffic
from clickmetrics.operators.prepare import clean_sessions
from clickmetrics.session import checkpoint_dir, cluster_conf
from clickmetrics.sources import browse, load_database, load_web_tables, materialize, read_table, save_table, use_database
from clickmetrics.sources.schema import SchemaError, check_columns, WEBSITE_PAGEVIEWS
from conftest import one


def _scratch(spark) -> str:
    return tempfile.mkdtemp(prefix="srcs-", dir=checkpoint_dir(spark))


def test_csv_keeps_text_marker_and_real_null(spark, golden):
    root = _scratch(spark)
    for name, df in [("website_sessions", golden.sessions), ("website_pageviews", golden.pageviews),
                     ("orders", golden.orders), ("order_items", golden.order_items)]:
        df.write.mode("overwrite").option("header", True).csv(os.path.join(root, f"{name}.csv"))
    t = load_web_tables(spark, root, fmt="csv")
    got = {r[0]: (r[1], r[2]) for r in t.sessions.select("website_session_id", "utm_source", "utm_content").collect()}
    assert got[3] == ("NULL", "NULL")  # text marker survives the load
    assert got[8] == (None, None)      # empty field is a real NULL
    assert one(traffic.organic_sessions(clean_sessions(t.sessions))) == (1,)
    assert t.order_items.schema["price_usd"].dataType.simpleString() == "decimal(10,2)"
    # Timestamps written by Spark (ISO form) come back whole, not NULL.
    assert sorted(tuple(r) for r in t.pageviews.select("website_pageview_id", "created_at").collect()) == \
        sorted(tuple(r) for r in golden.pageviews.select("website_pageview_id", "created_at").collect())


def test_parquet_round_trip_and_save_table(spark, golden):
    root = _scratch(spark)
    save_table(golden.pageviews, path=os.path.join(root, "website_pageviews.parquet"))
    back = read_table(spark, os.path.join(root, "website_pageviews.parquet"), "website_pageviews")
    assert back.count() == 23
    assert sorted(back.columns) == sorted(golden.pageviews.columns)


def test_materialize_cuts_lineage(spark, golden):
    m = materialize(spark, golden.sessions, "test-sessions")
    assert m.count() == 10
    assert "Scan parquet" in m._jdf.queryExecution().executedPlan().toString() or \
        "FileScan parquet" in m._jdf.queryExecution().executedPlan().toString()


def test_missing_column_fails_fast(spark, golden):
    with pytest.raises(SchemaError):
        check_columns(golden.pageviews.drop("pageview_url"), WEBSITE_PAGEVIEWS, "website_pageviews", optional=())


def test_cluster_conf_scales_with_input():
    small, big = cluster_conf(10 << 30), cluster_conf(100 << 40)
    assert int(small["spark.sql.shuffle.partitions"]) == 12000  # a few per core
    assert 12000 <= int(big["spark.sql.shuffle.partitions"]) <= 20000  # and not one per 256 MB of input


def test_database_and_select_into(spark, prepared):
    use_database(spark, "clickmetrics_test", location=os.path.join(_scratch(spark), "db"))
    try:
        path = os.path.join(_scratch(spark), "session_and_pageview")
        save_table(prepared.sp, path=path, name="session_and_pageview")
        back = spark.table("clickmetrics_test.session_and_pageview")
        assert back.count() == 23
        assert back.columns == prepared.sp.columns
        assert browse(back, 5).count() == 5
        for name, df in [("website_sessions", prepared.raw.sessions), ("website_pageviews", prepared.wp),
                         ("orders", prepared.o), ("order_items", prepared.oi)]:
            save_table(df, path=os.path.join(_scratch(spark), name), name=name)
        for tables in (load_database(spark), load_database(spark, "clickmetrics_test")):
            assert one(traffic.page_views(tables.pageviews)) == (23,)
    finally:
        spark.catalog.setCurrentDatabase("default")


def test_web_tables_checked(golden):
    from dataclasses import replace

    assert golden.checked().pageviews.columns == golden.pageviews.columns
    with pytest.raises(SchemaError):
        replace(golden, orders=golden.orders.drop("website_session_id")).checked()


def test_sessionized_events_row_groups_are_time_ordered(spark):
    import glob

    import pyarrow.parquet as pq

    from clickmetrics.sources.events import materialize_events, read_events
    from conftest import SF001

    label = "rowgroups-" + os.path.basename(_scratch(spark))
    t = materialize_events(spark, read_events(spark, SF001), label, row_group_bytes=1024)
    files = glob.glob(os.path.join(checkpoint_dir(spark), "web_tables", label, "sessionized_events", "event_date=*", "*.parquet"))
    groups = 0
    for f in files:
        md = pq.ParquetFile(f).metadata
        ts = [md.schema.column(i).name for i in range(md.num_columns)].index("ts")
        spans = [(md.row_group(g).column(ts).statistics.min, md.row_group(g).column(ts).statistics.max)
                 for g in range(md.num_row_groups)]
        groups += len(spans)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # increasing, non-overlapping
    assert groups > len(files)  # several row groups per file to skip between
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in \
        t.pageviews.filter("created_at >= TIMESTAMP_NTZ'2024-01-10 00:00:00'")._jdf.queryExecution().executedPlan().toString()


def test_derived_tables_follow_input_changes(spark):
    from pyspark.sql import functions as F

    from clickmetrics.sources.events import read_events, web_tables_for
    from conftest import SF0001

    root = _scratch(spark)
    events = read_events(spark, SF0001)
    events.write.parquet(os.path.join(root, "events.parquet"))
    first = web_tables_for(spark, root)
    assert web_tables_for(spark, root) is first  # same input: derived once
    n = first.pageviews.count()
    # New events for a new user arrive as another file of the same table.
    extra = events.limit(5).withColumn("user_id", F.lit(10_000_000).cast("long")).withColumn("event_id", F.col("event_id") + 10_000_000)
    extra.write.mode("append").parquet(os.path.join(root, "events.parquet"))
    second = web_tables_for(spark, root)
    assert second is not first
    assert second.pageviews.count() == n + 5


def test_csv_columns_are_taken_by_name(spark, golden):
    root = _scratch(spark)
    shuffled = golden.pageviews.select("pageview_url", "website_session_id", "created_at", "website_pageview_id")
    shuffled.write.option("header", True).csv(os.path.join(root, "website_pageviews.csv"))
    back = read_table(spark, os.path.join(root, "website_pageviews.csv"), "website_pageviews", "csv")
    cols = ["website_pageview_id", "created_at", "website_session_id", "pageview_url"]
    assert sorted(tuple(r) for r in back.select(*cols).collect()) == \
        sorted(tuple(r) for r in golden.pageviews.select(*cols).collect())
    assert back.schema["website_pageview_id"].dataType.simpleString() == "bigint"


def test_fingerprint_sees_a_file_rewritten_in_place(spark):
    """Same size, same number of files, below a nested folder: only the file's own time tells."""
    from clickmetrics.session import input_signature

    root = os.path.join(_scratch(spark), "events.parquet")
    spark.range(10).selectExpr("id", "id % 2 AS day").write.partitionBy("day").parquet(root)
    first = input_signature(spark, root)
    assert input_signature(spark, root) == first
    file = next(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))
    folder = os.stat(os.path.dirname(file))
    os.utime(file, (1_600_000_000, 1_600_000_000))
    os.utime(os.path.dirname(file), ns=(folder.st_atime_ns, folder.st_mtime_ns))
    assert input_signature(spark, root) != first
    single = os.path.join(os.path.dirname(root), "one.parquet")
    with open(single, "wb") as f:
        f.write(b"1234")
    before = input_signature(spark, single)
    os.utime(single, (1_600_000_000, 1_600_000_000))
    assert input_signature(spark, single) != before
