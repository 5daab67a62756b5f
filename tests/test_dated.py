"""Hits stored by day: range queries read the folders of their days, with the same results."""

from __future__ import annotations

import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from clickmetrics.operators import bounce, conversion
from clickmetrics.plans.catalog import ORDER_CUTOFF, TREND_END, TREND_START, Prepared
from clickmetrics.plans.reference import REFERENCE_PLANS, run_on_tables
from clickmetrics.session import checkpoint_dir
from clickmetrics.sources.dated import DATE, pruned, write_by_date
from clickmetrics.sources.events import web_tables_for
from conftest import SF0001, SF001, T, rows


def _scratch(spark):
    return tempfile.mkdtemp(prefix="dated-", dir=checkpoint_dir(spark))


RANGES = ["m27_weekly_trend", "m30_billing_test_cutoff", "m31_funnel", "m32_funnel_rates"]


@pytest.mark.parametrize("name", RANGES)
def test_range_queries_prune_folders(spark, name):
    plan = E.queries()[name](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any("event_date" in f and "<=" in f for f in filters), filters


def test_files_read_fall_with_the_range(spark):
    t = web_tables_for(spark, SF001)
    whole = set(t.hits().inputFiles())

    def files(start, end):
        used = t.dated_pageviews.where(F.col(DATE).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        return {r[0] for r in used.select(F.input_file_name()).distinct().collect()}

    three, ten = files("2024-01-05", "2024-01-07"), files("2024-01-05", "2024-01-14")
    assert len({os.path.dirname(f) for f in three}) == 3 and len({os.path.dirname(f) for f in ten}) == 10
    assert three < ten and len(ten) < len(whole)


def test_same_results_with_and_without_days(spark):
    p = Prepared(web_tables_for(spark, SF001))
    assert p.raw.dated_pageviews is not None and DATE not in p.wp.columns
    for with_days, without in [
            (bounce.weekly_page_trend(p.raw.hits(TREND_START, TREND_END), p.ws, start=TREND_START, end=TREND_END),
             bounce.weekly_page_trend(p.wp, p.ws, start=TREND_START, end=TREND_END)),
            (conversion.page_order_rate(p.raw.hits(end=ORDER_CUTOFF), p.o, before=ORDER_CUTOFF),
             conversion.page_order_rate(p.wp, p.o, before=ORDER_CUTOFF))]:
        assert sorted(rows(with_days)) == sorted(rows(without)) != []


EDGES = [T("2024-01-02 23:59:59.999999"), T("2024-01-03"), T("2024-01-03 12:00:00"), T("2024-01-04"), T("2024-01-04 00:00:00.000001"), None]


def test_range_edges(spark):
    """Inclusive bounds at midnight and inside a day; rows without a time are in no range and not lost."""
    df = spark.createDataFrame(list(enumerate(EDGES)), "id long, t timestamp_ntz")
    path = os.path.join(_scratch(spark), "edges")
    write_by_date(df, path, "t", 1 << 20)
    dated = spark.read.parquet(path)
    assert sorted(rows(pruned(dated)), key=str) == sorted(enumerate(EDGES), key=str)
    for start, end in [("2024-01-03", "2024-01-04"), ("2024-01-03 06:00:00", "2024-01-03 12:00:00"), (None, "2024-01-03"), ("2024-01-04", None)]:
        exact = F.lit(True)
        if start:
            exact &= F.col("t") >= F.lit(T(start)).cast("timestamp_ntz")
        if end:
            exact &= F.col("t") <= F.lit(T(end)).cast("timestamp_ntz")
        assert sorted(rows(pruned(dated, start, end).where(exact))) == sorted(rows(df.where(exact)))
    write_by_date(df.where("false"), os.path.join(_scratch(spark), "none"), "t", 1 << 20)


def test_a_hot_day_is_written_by_many_tasks(spark):
    """A day beyond the advisory size is split along map outputs, not written by one task."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "64k")
    try:
        df = spark.range(0, 200_000, 1, 16).select("id", F.xxhash64("id").alias("x"), F.when(
            F.col("id") % 3 == 0, F.lit("2024-01-01")).otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"))
                                                                 ).cast("timestamp_ntz").alias("t"))
        path = os.path.join(_scratch(spark), "hot")
        write_by_date(df, path, "t", 1 << 20)
        files = os.listdir(os.path.join(path, f"{DATE}=2024-01-01"))
        assert len([f for f in files if f.endswith(".parquet")]) >= 4
        assert spark.read.parquet(path).count() == 200_000
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def test_own_tables_by_day(spark, golden):
    """A user's pageviews written by day: reference parameters, same rows as without days."""
    plain, dated = _scratch(spark), _scratch(spark)
    for root in (plain, dated):
        for name, df in [("website_sessions", golden.sessions), ("orders", golden.orders), ("order_items", golden.order_items)]:
            df.write.parquet(f"{root}/{name}.parquet")
    golden.pageviews.write.parquet(f"{plain}/website_pageviews.parquet")
    write_by_date(golden.pageviews, f"{dated}/website_pageviews.parquet", "created_at", 1 << 20)
    for name in [*RANGES, "d3_website_pageviews"]:
        assert name in REFERENCE_PLANS
        a, b = run_on_tables(name, spark, plain), run_on_tables(name, spark, dated, dated=True)
        assert a.columns == b.columns and sorted(rows(a), key=str) == sorted(rows(b), key=str)
