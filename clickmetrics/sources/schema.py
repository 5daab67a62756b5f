"""Declared schemas of the web tables and a load-time column check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

WEBSITE_SESSIONS = T.StructType([
    T.StructField("website_session_id", T.LongType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("is_repeat_session", T.IntegerType(), True),
    T.StructField("utm_source", T.StringType(), True),
    T.StructField("utm_campaign", T.StringType(), True),
    T.StructField("utm_content", T.StringType(), True),
    T.StructField("device_type", T.StringType(), True),
    T.StructField("http_referer", T.StringType(), True),
])

WEBSITE_PAGEVIEWS = T.StructType([
    T.StructField("website_pageview_id", T.LongType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("website_session_id", T.LongType(), True),
    T.StructField("pageview_url", T.StringType(), True),
])

ORDERS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("website_session_id", T.LongType(), True),
])

ORDER_ITEMS = T.StructType([
    T.StructField("order_item_id", T.LongType(), False),
    T.StructField("order_id", T.LongType(), True),
    T.StructField("price_usd", T.DecimalType(10, 2), True),
])

SCHEMAS = {
    "website_sessions": WEBSITE_SESSIONS,
    "website_pageviews": WEBSITE_PAGEVIEWS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
}

# Column order of the derived session/pageview table (reference select list).
SESSION_PAGEVIEW_COLUMNS = [
    "pageview_url", "created_at", "website_pageview_id", "website_session_id",
    "device_type", "is_repeat_session", "user_id", "utm_campaign", "utm_content",
    "utm_source", "http_referer",
]


class SchemaError(ValueError):
    pass


def check_columns(df: DataFrame, schema: T.StructType, name: str, optional=("created_at",)) -> DataFrame:
    """Fail fast if a required column is missing; cast present columns to the declared type.

    Extra columns pass through untouched (column pruning drops them later).
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have and f.name not in optional]
    if missing:
        raise SchemaError(f"{name}: missing columns {missing}")
    out = df
    for f in schema.fields:
        if f.name in have and have[f.name] != f.dataType:
            out = out.withColumn(f.name, out[f.name].cast(f.dataType))
    return out
