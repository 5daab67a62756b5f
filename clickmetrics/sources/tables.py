"""The web tables a metric reads, and how to load them (Parquet or CSV)."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmetrics.sources.dated import DATE, pruned
from clickmetrics.sources.evolving import read_evolving
from clickmetrics.sources.schema import (
    ORDER_ITEMS,
    ORDERS,
    SCHEMAS,
    WEBSITE_PAGEVIEWS,
    WEBSITE_SESSIONS,
    check_columns,
)


# Case by Unicode lower case, accents kept apart, trailing blanks ignored.
SERVER_COLLATION = "UTF8_LCASE_RTRIM"


def _collated(df: DataFrame, collation: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast(f"string collate {collation}").alias(c) if kind == "string" else F.col(f"`{c}`")
                       for c, kind in df.dtypes])


@dataclass(frozen=True)
class WebTables:
    """Sessions, pageviews, orders and order items (plus the two browse-only tables).

    ``sessions`` may be raw (text ``'NULL'`` markers) or cleaned; see
    :func:`clickmetrics.operators.prepare.clean_sessions`.
    """

    sessions: DataFrame
    pageviews: DataFrame
    orders: DataFrame
    order_items: DataFrame
    products: DataFrame | None = None
    order_item_refunds: DataFrame | None = None
    # the same pageviews with event_date, where they are stored by day (sources.dated)
    dated_pageviews: DataFrame | None = None

    def hits(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Pageviews, at least all with ``start <= created_at <= end``: only the days of the range where they are stored by day."""
        return self.pageviews if self.dated_pageviews is None else pruned(self.dated_pageviews, start, end)

    def collated(self, collation: str = SERVER_COLLATION) -> "WebTables":
        """The same tables whose text compares, groups and joins under ``collation`` (FL-1, FL-2), by default without regard
        to case and trailing blanks, as the reference's server does.  Values keep their spelling; a group shows
        the spelling of one of its rows.  Predicates on such columns aren't pushed into the scan (their statistics are
        binary); those on time and ids are, and their columns are pruned as before."""
        tables = {f.name: getattr(self, f.name) for f in fields(self)}
        return WebTables(**{name: df if df is None else _collated(df, collation) for name, df in tables.items()})

    def checked(self) -> "WebTables":
        return replace(
            self,
            sessions=check_columns(self.sessions, WEBSITE_SESSIONS, "website_sessions"),
            pageviews=check_columns(self.pageviews, WEBSITE_PAGEVIEWS, "website_pageviews", optional=()),
            orders=check_columns(self.orders, ORDERS, "orders"),
            order_items=check_columns(self.order_items, ORDER_ITEMS, "order_items"),
        )


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Scan one base table with its declared schema.

    Parquet keeps its own (columnar, predicate-pushdown) schema and is checked
    against the declared one.  CSV columns are taken by header name as text
    and cast to the declared types; the text ``'NULL'`` is *not* turned into
    SQL NULL (the reference treats it as an ordinary string and cleans it
    later), while empty fields are NULL.
    """
    schema = SCHEMAS.get(name)
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "csv":
        # Columns are taken by their header names, as text, then cast to the declared
        # types (check_columns); an explicit schema would be applied by position and
        # silently misassign columns of a file in another order.  Empty fields are
        # NULL; the text 'NULL' stays text.  Spark's timestamp_ntz cast accepts both
        # "2012-06-02 23:00:30" and the ISO "2012-06-02T23:00:30.5" form.
        df = spark.read.option("header", True).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return check_columns(df, schema, name) if schema is not None else df


def load_database(spark: SparkSession, database: str | None = None) -> WebTables:
    """The web tables of a catalog database (default: the current one), by table name."""
    def named(n: str) -> str:
        return f"`{database}`.`{n}`" if database else n

    def table(n: str) -> DataFrame:
        df = spark.table(named(n))
        return check_columns(df, SCHEMAS[n], n) if n in SCHEMAS else df

    def optional(n: str) -> DataFrame | None:
        return table(n) if spark.catalog.tableExists(named(n)) else None

    return WebTables(sessions=table("website_sessions"), pageviews=table("website_pageviews"), orders=table("orders"),
                     order_items=table("order_items"), products=optional("products"),
                     order_item_refunds=optional("order_item_refunds"))


def load_web_tables(spark: SparkSession, root: str, fmt: str = "parquet", dated: bool = False) -> WebTables:
    """Load ``website_sessions``, ``website_pageviews``, ``orders``, ``order_items``
    (and, if present, ``products`` / ``order_item_refunds``, with the schema their files have) from ``root/<name>.<fmt>``.

    ``dated``: the pageviews were written by :func:`clickmetrics.sources.dated.write_by_date` over ``created_at``."""
    from clickmetrics.session import path_exists

    def path(n: str) -> str:
        return f"{root.rstrip('/')}/{n}.{fmt}"

    def optional(n: str) -> DataFrame | None:
        p = path(n)
        if not path_exists(spark, p):
            return None
        return read_evolving(spark, p) if fmt == "parquet" else read_table(spark, p, n, fmt)

    hits = read_table(spark, path("website_pageviews"), "website_pageviews", fmt)
    return WebTables(
        sessions=read_table(spark, path("website_sessions"), "website_sessions", fmt),
        pageviews=hits.drop(DATE) if dated else hits,
        dated_pageviews=hits if dated else None,
        orders=read_table(spark, path("orders"), "orders", fmt),
        order_items=read_table(spark, path("order_items"), "order_items", fmt),
        products=optional("products"),
        order_item_refunds=optional("order_item_refunds"),
    )
