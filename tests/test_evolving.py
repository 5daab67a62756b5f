"""Tables of unknown schema: columns united and types widened over all files (D3 products, order_item_refunds)."""

from __future__ import annotations

import datetime as dt
import tempfile
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from clickmetrics.plans.reference import run_on_tables
from clickmetrics.session import checkpoint_dir
from clickmetrics.sources.evolving import read_evolving, united, widen
from clickmetrics.sources.schema import SchemaError
from conftest import rows


def _table(spark, *files: dict) -> str:
    root = tempfile.mkdtemp(prefix="evolving-", dir=checkpoint_dir(spark))
    for i, columns in enumerate(files):
        pq.write_table(pa.table(columns), f"{root}/part-{i:03d}.parquet")
    return root


def test_columns_are_united(spark):
    root = _table(spark, {"product_id": [1, 2], "name": ["a", "b"]}, {"product_id": [3], "price": [1.5]}, {"Name": ["c"], "product_id": [4]})
    df = read_evolving(spark, root)
    assert df.columns == ["product_id", "name", "price"]
    assert sorted(rows(df)) == [(1, "a", None), (2, "b", None), (3, None, 1.5), (4, "c", None)]


def test_types_are_widened_and_no_row_is_lost(spark):
    day = dt.date(2012, 3, 1)
    root = _table(
        spark,
        {"id": pa.array([1], pa.int32()), "v": pa.array([1], pa.int64()), "t": pa.array([day]), "m": pa.array([Decimal("1.5")], pa.decimal128(5, 2)), "x": [7]},
        {"id": pa.array([2**40], pa.int64()), "v": pa.array([2.5]), "t": pa.array([dt.datetime(2012, 3, 2, 4)], pa.timestamp("us")),
         "m": pa.array([12345], pa.int32()), "x": ["seven"]},
        {"id": pa.array([3], pa.int16()), "v": pa.array([None], pa.float32()), "t": pa.array([None], pa.date32()),
         "m": pa.array([Decimal("0.125")], pa.decimal128(10, 3)), "x": [None]},
        {"id": pa.array([], pa.int32())})
    df = read_evolving(spark, root)
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {
        "id": "bigint", "v": "double", "t": "timestamp_ntz", "m": "decimal(13,3)", "x": "string"}
    assert sorted(rows(df)) == [
        (1, 1.0, dt.datetime(2012, 3, 1), Decimal("1.500"), "7"), (3, None, None, Decimal("0.125"), None),
        (2**40, 2.5, dt.datetime(2012, 3, 2, 4), Decimal("12345.000"), "seven")]


def test_one_scan_per_distinct_schema(spark):
    """Types that change back and forth over many files: parts of one schema are read together."""
    root = _table(spark, *[{"id": pa.array([i], pa.int32() if i % 2 else pa.int64())} for i in range(12)])
    df = read_evolving(spark, root)
    assert sorted(rows(df)) == [(i,) for i in range(12)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2


def test_nested_types_have_to_agree(spark):
    assert sorted(rows(read_evolving(spark, _table(spark, {"a": [[1]]}, {"a": [[2]], "b": [1]})))) == [([1], None), ([2], 1)]
    with pytest.raises(SchemaError, match="a is"):
        read_evolving(spark, _table(spark, {"a": [[1]]}, {"a": [1]}))


def test_widening_rules():
    w = lambda a, b: (widen(a, b, "c"), widen(b, a, "c"))
    assert w(T.ByteType(), T.ShortType()) == (T.ShortType(),) * 2
    assert w(T.LongType(), T.FloatType()) == (T.DoubleType(),) * 2
    assert w(T.DecimalType(38, 0), T.DecimalType(10, 9)) == (T.StringType(),) * 2
    assert w(T.BooleanType(), T.LongType()) == (T.StringType(),) * 2
    assert w(T.NullType(), T.DateType()) == (T.DateType(),) * 2
    assert united([]) == T.StructType([])


def test_browse_queries(spark, golden):
    root = tempfile.mkdtemp(prefix="browse-", dir=checkpoint_dir(spark))
    for name, df in [("website_sessions", golden.sessions), ("website_pageviews", golden.pageviews), ("orders", golden.orders), ("order_items", golden.order_items)]:
        df.write.parquet(f"{root}/{name}.parquet")
    spark.sql("select 1 product_id, 'Bear' product_name").write.parquet(f"{root}/products.parquet")
    spark.sql("select 2L product_id, date'2012-02-03' created").write.mode("append").parquet(f"{root}/products.parquet")
    assert sorted(rows(run_on_tables("d3_products", spark, root), "product_id", "product_name", "created")) == [
        (1, "Bear", None), (2, None, dt.date(2012, 2, 3))]
    with pytest.raises(ValueError, match="order_item_refunds"):
        run_on_tables("d3_order_item_refunds", spark, root)
