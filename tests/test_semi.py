"""Bit-filtered semi joins (FL-6, JN-8), row-grain COUNT(*) OVER (WN-4), saved tables and the SOUNDEX SQL."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from clickmetrics.functions.compat import soundex_difference
from clickmetrics.operators import semi
from clickmetrics.operators.sessions import counted_hits
from clickmetrics.plans.oracle import _difference
from conftest import SF0001, rows


def test_bit_filter_keeps_every_partner(spark):
    big = spark.range(20_000).select(F.when(F.col("id") % 50 != 0, F.col("id") % 700).alias("k"), F.col("id").alias("_word"))
    keys = spark.range(40).select((F.col("id") * 7).alias("k")).unionByName(spark.sql("select cast(null as long) k"))
    for words in (1, 4, semi.WORDS):
        near = semi.bit_filter(big, keys, "k", words)
        assert near.columns == big.columns
        want = rows(big.join(keys, "k", "left_semi").select(*big.columns))
        got = rows(near)
        assert set(want) <= set(got) and len(got) == len(set(got))
        assert sorted(rows(semi.rows_of_keys(big, keys.unionByName(keys), "k", words=words))) == sorted(want)
    # 40 keys over 16.8 million bits: no foreign row is left
    assert len(got) == len(want)


@pytest.mark.parametrize("kind", ["string", "date", "timestamp_ntz"])
def test_bit_filter_on_other_types(spark, kind):
    value = {"string": F.concat(F.lit("s"), F.col("id")), "date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")),
             "timestamp_ntz": F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp_ntz")}[kind]
    big = spark.range(300).select(value.alias("k"), "id")
    keys = big.where("id % 9 = 0").select("k")
    assert sorted(r[1] for r in rows(semi.rows_of_keys(big, keys, "k"))) == list(range(0, 300, 9))


def test_bit_filter_leaves_mixed_types_to_the_join(spark):
    big = spark.range(100).select(F.col("id").cast("int").alias("k"))
    keys = spark.range(0, 100, 10).select(F.col("id").alias("k"))
    assert semi.bit_filter(big, keys, "k") is big
    assert sorted(r[0] for r in rows(semi.rows_of_keys(big, keys, "k"))) == list(range(0, 100, 10))
    doubles = spark.sql("select -0.0D k")
    assert rows(semi.rows_of_keys(doubles, spark.sql("select 0.0D k"), "k")) == [(0.0,)]


def test_empty_sides(spark):
    some, none = spark.range(5).select(F.col("id").alias("k")), spark.range(0).select(F.col("id").alias("k"))
    assert rows(semi.rows_of_keys(some, none, "k")) == [] == rows(semi.rows_of_keys(none, some, "k"))


def test_key_bits_are_bounded(spark):
    bits = semi.key_bits(spark.range(50_000), "id", 64)
    assert bits.count() == 64
    assert bits.agg(F.sum(F.bit_count("_mask"))).first()[0] == 64 * 64


CAMPAIGN = ["m26_landing_ab_test", "m27_weekly_trend", "m31_funnel", "m32_funnel_rates", "fl6_campaign_hits"]


@pytest.mark.parametrize("name", CAMPAIGN)
def test_campaign_reaches_the_hits_before_they_move(spark, name):
    """On the way from the hit scan (the one that reads event_type) to its first exchange stands the broadcast
    join with the bits and the test of the bit, and no window spans a session."""
    plan = E.queries()[name](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    depth = [len(re.match(r"[\s:|+*()0-9-]*", x).group()) for x in lines]
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "event_type" in x)
    above, at = [], depth[scan]
    for i in range(scan - 1, -1, -1):
        if depth[i] < at:
            at = depth[i]
            above.append(lines[i])
            if re.search(r"\bExchange ", lines[i]):
                break
    text = "\n".join(above)
    assert "BroadcastHashJoin" in text and "_word" in text and "_mask" in text, text
    assert "Window" not in plan


def test_count_at_row_grain(spark):
    """Nulls are one group; a hot session is split; equal to the window."""
    hits = spark.range(3000).select(
        F.col("id").alias("website_pageview_id"),
        F.when(F.col("id") % 3 == 0, F.lit(1).cast("long")).when(F.col("id") % 31 != 0, F.col("id") % 97).alias("website_session_id"))
    hits.createOrReplaceTempView("wn4_hits")
    want = spark.sql("select *, count(*) over (partition by website_session_id) n from wn4_hits")
    for threshold in (50, 2_000_000):
        got = counted_hits(hits, "n", threshold)
        assert got.columns == want.columns and sorted(rows(got), key=str) == sorted(rows(want), key=str)
    assert rows(counted_hits(hits.where("false"), "n")) == []


def test_saved_table_is_the_derived_one(spark):
    before = spark.catalog.currentDatabase()
    saved = E.queries()["src4_saved_table"](spark, SF0001)
    derived = E.queries()["t3_session_pageviews"](spark, SF0001)
    assert spark.catalog.currentDatabase() == before
    assert spark.catalog.databaseExists("web_analytics")
    assert sorted(rows(saved), key=str) == sorted(rows(derived), key=str)


def test_soundex_sql_equals_spark(spark):
    words = ["Robert", "Rupert", "Rubin", "Ashcraft", "Ashcroft", "Tymczak", "Pfister", "Honeyman", "a", "", "7", "12x", "o'Hara",
             "Hwhw", "bbb", "Lloyd", "Jackson", "x-ray", "Wheaton", "Gutierrez"]
    pairs = [(a, b) for a in words for b in words[:8]]
    got = rows(spark.createDataFrame(pairs, "a string, b string").select("a", "b", soundex_difference("a", "b")))
    con = duckdb.connect()
    con.execute("CREATE TABLE p(a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", pairs)
    assert sorted(got) == sorted(con.sql(f"SELECT a, b, {_difference('a', 'b')} FROM p").fetchall())
