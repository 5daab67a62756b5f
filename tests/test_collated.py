"""Text compared without case and trailing blanks, as an option: every plan groups mixed spellings as one."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from clickmetrics.plans.catalog import Prepared
from clickmetrics.plans.reference import REFERENCE_PLANS, run_on_tables
from clickmetrics.sources.tables import SERVER_COLLATION
from conftest import rows

PLANS = sorted(set(REFERENCE_PLANS) - {"d3_products", "d3_order_item_refunds"})


def _respelled(df, row):
    """Every second row's text in capitals with trailing blanks."""
    return df.select(*[F.when(F.col(row) % 2 == 0, F.concat(F.upper(c), F.lit("  "))).otherwise(F.col(c)).alias(c) if kind == "string" else F.col(c)
                       for c, kind in df.dtypes])


@pytest.fixture(scope="module")
def respelled(golden):
    return replace(golden, sessions=_respelled(golden.sessions, "website_session_id"),
                   pageviews=_respelled(golden.pageviews, "website_pageview_id"))


def _plain(df):
    return sorted([tuple(v.rstrip(" ").lower() if isinstance(v, str) else v for v in r) for r in rows(df)], key=str)


@pytest.mark.parametrize("name", PLANS)
def test_spellings_are_one_value(golden, respelled, name):
    got = REFERENCE_PLANS[name](Prepared(respelled.collated()))
    want = REFERENCE_PLANS[name](Prepared(golden))
    assert got.columns == want.columns and _plain(got) == _plain(want)


def test_default_stays_binary(golden, respelled):
    assert _plain(REFERENCE_PLANS["m11_top_pages"](Prepared(respelled))) != _plain(REFERENCE_PLANS["m11_top_pages"](Prepared(golden)))
    assert {f.dataType.simpleString() for f in respelled.sessions.schema} == {"bigint", "int", "string", "timestamp_ntz"}
    assert dict(respelled.collated().pageviews.dtypes)["pageview_url"] == f"string collate {SERVER_COLLATION}"


def test_accents_inner_blanks_and_nulls_stay_apart(spark, golden):
    urls = ["/a", "/A ", "/á", "/ a", "\t/a", "", " ", None]
    hits = spark.createDataFrame([(i, None, 1, u) for i, u in enumerate(urls)], golden.pageviews.schema)
    got = REFERENCE_PLANS["m11_top_pages"](Prepared(replace(golden, pageviews=hits).collated()))
    counts = {None if u is None else u.rstrip(" ").lower(): n for u, n in rows(got)}
    assert counts == {"/a": 2, "/á": 1, "/ a": 1, "\t/a": 1, "": 2, None: 0}


def test_written_tables(spark, respelled, golden, tmp_path):
    for name, df in [("website_sessions", respelled.sessions), ("website_pageviews", respelled.pageviews),
                     ("orders", respelled.orders), ("order_items", respelled.order_items)]:
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = run_on_tables("m27_weekly_trend", spark, str(tmp_path), collate=True)
    assert rows(got) == rows(REFERENCE_PLANS["m27_weekly_trend"](Prepared(golden))) != []
