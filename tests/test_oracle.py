"""Every registered query equals its DuckDB oracle on the events-derived tables (sf0.001)."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from clickmetrics.plans.catalog import CATALOG
from conftest import SF0001
from tools.check_oracle import canon

QUERIES = {name: q for name, q in E.queries().items() if name in CATALOG}
ORACLE = {name: sql for name, sql in E.oracle_sql().items() if name in CATALOG}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{Path(SF0001) / 'events.parquet'}')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


# Spark result type -> DuckDB result type name.
DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF0001)
    got = canon(df.columns, df.collect())
    r = con.sql(ORACLE[name])
    want = canon(r.columns, r.fetchall())
    assert got == want
    spark_types = {f.name: DUCK.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
                   for f in df.schema.fields}
    assert spark_types == {c: str(t) for c, t in zip(r.columns, r.types)}


def test_entry_is_flagship(spark):
    df = E.entry(spark)
    assert df.columns == ["week_start_date", "entry_page", "total_sessions", "bounced_sessions", "bounce_rate"]
    assert df.count() >= 0
