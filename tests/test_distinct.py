"""Distinct counts by bitmaps: equal to COUNT(DISTINCT), merged as the rows would be, planned without Expand."""

from __future__ import annotations

import re

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from clickmetrics.operators import distinct
from conftest import SF0001, rows
from tools.check_oracle import canon

NAMES = ["n_all", "n_even", "n_none"]
WANT = ("count(distinct id) n_all, count(distinct case when x % 2 = 0 then id end) n_even, 0L n_none, count(x) n_x")


def _masks():
    return {"n_all": None, "n_even": F.col("x") % 2 == 0, "n_none": F.lit(False)}


def _equal(spark, df, by):
    df.createOrReplaceTempView("distinct_rows")
    groups = ", ".join(by)
    want = spark.sql(f"select {groups + ', ' if by else ''}{WANT} from distinct_rows {'group by ' + groups if by else ''}")
    got = distinct.distinct_counts(df, "id", _masks(), by, {"n_x": F.col("x")})
    assert got.columns == want.columns
    assert sorted(rows(got), key=str) == sorted(rows(want), key=str)


EDGES = [-(2**63), -(2**63) + 1, -65, -64, -63, -1, 0, 1, 63, 64, 65, 2**15, 2**31, 2**63 - 1, None]


@given(st.lists(st.tuples(st.sampled_from(EDGES) | st.integers(-200, 200), st.none() | st.integers(0, 3),
                          st.sampled_from(["a", "b", None])), max_size=60))
def test_equals_count_distinct(spark, data):
    df = spark.createDataFrame(data, "id long, x int, g string")
    _equal(spark, df, [])
    _equal(spark, df, ["g"])


@pytest.mark.parametrize("kind", distinct.INTEGERS)
def test_integer_types(spark, kind):
    df = spark.range(300).select((F.col("id") % 120).cast(kind).alias("id"), (F.col("id") % 5).cast("int").alias("x"), F.lit("a").alias("g"))
    _equal(spark, df, ["g"])


def test_text_ids_have_to_be_numbered(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 11 != 0, F.concat(F.lit("u"), F.hash(F.col("id") % 700))).alias("name"), "id")
    with pytest.raises(TypeError, match="number_ids"):
        distinct.distinct_counts(df, "name", {"n": None})
    numbers = distinct.number_ids(spark, df, "name", "test-distinct-numbers")
    got = rows(numbers)
    names = sorted(r[0] for r in rows(df.select("name").distinct()) if r[0] is not None)
    assert sorted(got) == list(zip(names, range(len(names)), strict=True))
    joined = df.join(numbers, "name", "left")
    assert rows(distinct.distinct_counts(joined, "number", {"n": None})) == [(len(names),)]
    assert rows(distinct.number_ids(spark, df.where("false"), "name", "test-distinct-none")) == []


def test_bitmaps_of_days_add_up(spark):
    """Merging finer groups, or the tables of two loads, equals counting all rows."""
    df = spark.range(4000).select((F.col("id") * 7919 % 900).alias("id"), (F.col("id") % 6).cast("int").alias("x"), (F.col("id") % 9).alias("day"))
    old, new = [distinct.id_bitmaps(part, "id", _masks(), ["day"], {"n_x": F.col("x")}) for part in (df.where("day < 5"), df.where("day >= 4"))]
    merged = distinct.merge_bitmaps(old, new, masks=NAMES, by=["day"])
    want = distinct.distinct_counts(df, "id", _masks(), ["day"])
    assert sorted(rows(distinct.count_bitmaps(merged, NAMES, ["day"]))) == sorted(rows(want))
    total = distinct.merge_bitmaps(merged, masks=NAMES)
    assert rows(distinct.count_bitmaps(total, NAMES)) == rows(distinct.distinct_counts(df, "id", _masks()))


def test_no_expand_and_rows_bounded_by_words(spark):
    """One aggregate in generated code, no Expand; a map task sends a 64th of its dense ids, where
    COUNT(DISTINCT) sends each of them."""
    df = spark.range(0, 64_000, 1, 4).select("id", (F.col("id") % 3).cast("int").alias("x"))
    out = distinct.distinct_counts(df, "id", _masks())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "SortAggregate" not in plan and "ObjectHash" not in plan
    literal = df.agg(F.countDistinct("id"), F.countDistinct(F.when(F.col("x") == 0, F.col("id"))))
    assert "Expand" in literal._jdf.queryExecution().executedPlan().toString()
    assert distinct.id_bitmaps(df, "id", _masks()).count() == 1000
    assert rows(out) == rows(df.agg(F.countDistinct("id"), F.countDistinct(F.when(F.col("x") % 2 == 0, F.col("id"))), F.lit(0).cast("long")))


DISTINCT = ["m02_unique_visitors", "m10_conversion_rate", "m19_organic_users", "m20_organic_reach", "ag6_visitor_reach"]


@pytest.mark.parametrize("name", DISTINCT)
def test_queries_use_bitmaps(spark, name):
    plan = E.queries()[name](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "Expand" not in plan
    assert not re.search(r"count\(distinct", plan)


def test_visitor_reach_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF0001}/events.parquet')")
    df = E.queries()["ag6_visitor_reach"](spark, SF0001)
    r = con.sql(E.oracle_sql()["ag6_visitor_reach"])
    assert canon(df.columns, df.collect()) == canon(r.columns, r.fetchall())
