"""Dense ranks and next values by boundary carry against plain Python and DuckDB-like definitions."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from clickmetrics.operators.ordered import NEXT, RANK, ordered_scan

T0 = dt.datetime(2024, 1, 1)
_rows = st.lists(st.tuples(st.sampled_from([1, 2, None]), st.one_of(st.none(), st.integers(0, 6))), max_size=40)


def plain(rows):
    out = []
    for i, k, t in rows:
        mine = {u for _, q, u in rows if q == k}
        before = sum((u is None and t is not None) or (u is not None and t is not None and u < t) for u in mine)
        out.append((i, k, t, before + 1, min((u for u in mine if None not in (u, t) and u > t), default=None)))
    return Counter(out)


@given(_rows, st.sampled_from([1, 3, 25]), st.sampled_from([2, 10_000]))
def test_equals_plain(spark, pairs, partitions, batch):
    rows = [(i, k, None if t is None else T0 + dt.timedelta(seconds=t)) for i, (k, t) in enumerate(pairs)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "id long, k long, t timestamp_ntz")
        got = ordered_scan(df, ["k"], "t", ["id"], partitions).select("id", "k", "t", RANK, NEXT)
        assert Counter(map(tuple, got.collect())) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_other_types_and_two_keys(spark):
    rows = [(i, "ab"[i % 2], i % 3, f"v{i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a string, b int, v string")
    got = Counter(map(tuple, ordered_scan(df, ["a", "b"], "v", ["id"], 9).select("id", RANK, NEXT).collect()))
    want = Counter()
    for i, a, b, v in rows:
        mine = sorted({r[3] for r in rows if r[1:3] == (a, b)})
        want[(i, mine.index(v) + 1, next((u for u in mine if u > v), None))] += 1
    assert got == want


def test_a_union_around_it_changes_nothing(spark):
    """Partition numbers shift inside a union; what partitions owe each other is found by value."""
    rows = [(i, i % 2, T0 + dt.timedelta(seconds=i // 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, k long, t timestamp_ntz")
    scan = ordered_scan(df, ["k"], "t", ["id"], 8)
    both = scan.unionByName(ordered_scan(df, ["k"], "t", ["id"], 5)).select("id", "k", "t", RANK, NEXT)
    want = plain(rows)
    assert Counter(map(tuple, both.collect())) == want + want


def test_without_exchange_reuse_it_refuses(spark):
    df = spark.createDataFrame([(1, 1, 1)], "id long, k long, t long")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        with pytest.raises(ValueError):
            ordered_scan(df, ["k"], "t")
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_one_hot_key_spreads(spark):
    """A third of the rows in one key at one time: no partition holds twice its even share."""
    from pyspark.sql import functions as F

    df = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"),
                                    F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("t"))
    scan = ordered_scan(df, ["k"], "t", ["id"], 20).withColumn("p", F.spark_partition_id())
    most = scan.groupBy("p").count().agg(F.max("count")).first()[0]
    assert most <= 2 * 60_000 / 20
