"""Reference parameters on the user's own tables: the golden fixture written as
Parquet and read back, with the 2012 literals of the reference."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest

from clickmetrics.__main__ import main
from clickmetrics.plans.reference import REFERENCE_PLANS, run_on_tables
from clickmetrics.session import checkpoint_dir
from conftest import one, rows


@pytest.fixture(scope="module")
def tables_dir(spark, golden):
    root = tempfile.mkdtemp(prefix="golden-tables-", dir=checkpoint_dir(spark))
    for name, df in [("website_sessions", golden.sessions), ("website_pageviews", golden.pageviews),
                     ("orders", golden.orders), ("order_items", golden.order_items)]:
        df.write.parquet(os.path.join(root, f"{name}.parquet"))
    return root


def test_weekly_trend_reference_range(spark, tables_dir):
    got = rows(run_on_tables("m27_weekly_trend", spark, tables_dir))
    assert got == [
        (dt.datetime(2012, 5, 28), "/home", 1, 1, 100.0),
        (dt.datetime(2012, 6, 4), "/lander-1", 1, 0, 0.0),
        (dt.datetime(2012, 8, 6), "/lander-1", 2, 0, 0.0),
        (dt.datetime(2012, 8, 27), "/lander-1", 1, 1, 100.0),
    ]


def test_funnel_and_cutoff_reference_params(spark, tables_dir):
    assert one(run_on_tables("m31_funnel", spark, tables_dir)) == (4, 2, 1, 1, 1, 1, 1, 50.0, 50.0, 100.0, 100.0, 100.0, 100.0)
    assert rows(run_on_tables("m30_billing_test_cutoff", spark, tables_dir)) == [("/billing", 2, 2, 1.0)]


def test_every_reference_plan_runs_on_tables(spark, tables_dir):
    for name in REFERENCE_PLANS:
        run_on_tables(name, spark, tables_dir).collect()


def test_cli_list_and_run(spark, tables_dir, capsys):
    assert main(["list"]) == 0
    assert "m26_landing_ab_test" in capsys.readouterr().out
    out = os.path.join(tempfile.mkdtemp(prefix="cli-", dir=checkpoint_dir(spark)), "m26")
    assert main(["run", "m26_landing_ab_test", "--tables", tables_dir, "--out", out]) == 0
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [("Home", 1, 1, 100.0), ("Lander-1", 5, 2, 40.0)]
    assert main(["run", "no_such_analysis", "--tables", tables_dir]) == 2
