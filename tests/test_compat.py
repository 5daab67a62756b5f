"""Scalar goldens of the dialect helpers (FIXTURES.md §2, last paragraph)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from clickmetrics.functions import (boundary_diff, int_avg, ntz, pct, round_half_away, safe_ratio,
                                    soundex_difference, week_start)
from conftest import one


def test_boundary_minutes_count_crossings(spark):
    df = spark.range(1).select(ntz("2012-06-03 00:00:59").alias("a"), ntz("2012-06-03 00:01:01").alias("b"))
    assert one(df.select(boundary_diff("MINUTE", "a", "b"), boundary_diff("SECOND", "a", "b"))) == (1, 2)


def test_week_start_sunday_goes_to_next_monday(spark):
    df = spark.range(1).select(week_start(ntz("2012-06-02 23:00:00")).alias("sat"),
                               week_start(ntz("2012-06-03 10:00:00")).alias("sun"),
                               week_start(ntz("2012-06-04 00:00:00")).alias("mon"))
    assert one(df) == (dt.datetime(2012, 5, 28), dt.datetime(2012, 6, 4), dt.datetime(2012, 6, 4))


def test_week_start_is_time_zone_free(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.range(1).select(week_start(ntz("2024-03-10 01:30:00")).alias("w"),
                                   boundary_diff("MINUTE", ntz("2024-03-10 01:30:00"), ntz("2024-03-10 03:30:00")))
        assert one(df) == (dt.datetime(2024, 3, 11), 120)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_round_half_away_from_zero(spark):
    got = one(spark.range(1).select(round_half_away(F.lit(2.675), 2), round_half_away(F.lit(0.125), 2),
                                    round_half_away(F.lit(-0.125), 2), round_half_away(F.lit(2.5), 0)))
    assert got == (2.68, 0.13, -0.13, 3.0)


def test_round_uses_the_binary_value(spark):
    # 1.005 is stored as 1.00499999...; Spark's text-based round would give 1.01.
    assert one(spark.range(1).select(round_half_away(F.lit(1.005), 2), round_half_away(F.lit(105.52499999999999), 2))) \
        == (1.0, 105.53)


def test_integer_average_truncates(spark):
    df = spark.createDataFrame([(3,), (4,)], "x int")
    assert one(df.agg(int_avg("x"))) == (3,)
    assert one(df.filter("x > 10").agg(int_avg("x"))) == (None,)


def test_soundex_difference_of_digits_is_4(spark):
    df = spark.createDataFrame([("8", "2", "Robert", "Rupert", "Smith", "Jones")], "a string, b string, c string, d string, e string, f string")
    got = one(df.select(soundex_difference("a", "b"), soundex_difference("c", "d"), soundex_difference("e", "f")))
    assert got[0] == 4 and got[1] == 4 and got[2] < 4


def test_zero_denominator_is_null_and_guarded_ratio_is_zero(spark):
    df = spark.range(1).select(F.lit(3).alias("n"), F.lit(0).alias("d"))
    assert one(df.select(pct(F.col("n"), F.col("d")), safe_ratio(F.col("n"), F.col("d")))) == (None, 0.0)


def test_epoch_micros_ignores_session_zone_even_in_dst_gap(spark):
    import datetime as dt

    from clickmetrics.functions import epoch_micros

    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        # 02:30 does not exist in Los Angeles on 2024-03-10 (clocks jump 02:00 -> 03:00).
        df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 0, 123456),), (dt.datetime(1969, 12, 31, 23, 59, 59),)],
                                   "t timestamp_ntz")
        got = [r[0] for r in df.select(epoch_micros("t")).collect()]
        assert got == [1710037800123456, -1000000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
