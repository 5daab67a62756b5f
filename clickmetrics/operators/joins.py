"""Equi-joins whose large side may concentrate on a few keys.

A key holding a large share of the large side would put all its rows into
one reduce task.  :func:`skew_join` splits only such *hot* keys: each gets a
fan-out of ``ceil(rows / threshold)``, without a cap; its rows on the large side
are spread over that many sub-keys by a hash of their identity, and its rows
on the small side are replicated once per sub-key.  Cold keys join exactly as
before, so ordinary data pays nothing.

A key is hot above ``limit`` rows: ``threshold``, or a :data:`MOST_HOT_KEYS`-th
part of all rows where that is more.  So there are fewer than
:data:`MOST_HOT_KEYS` hot keys at any size of the data, and their table (a key
and a few numbers each) is broadcast under that bound.  ``threshold`` is a plan
parameter (rows that one task may hold of a key); results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows per key above which a key is split.
HOT_KEY_ROWS = 2_000_000
# No more keys than this are hot: the bound of what is broadcast.
MOST_HOT_KEYS = 100_000


def hot_limit(counts: DataFrame, count_col: str, threshold: int = HOT_KEY_ROWS) -> Column:
    """Rows above which a key of ``counts`` is hot: a scalar, evaluated once with the plan."""
    share = counts.agg(F.expr(f"sum({count_col}) div {MOST_HOT_KEYS}").alias("_share")).scalar()
    return F.greatest(F.lit(int(threshold)).cast("long"), share)


def hot_keys(counts: DataFrame, keys: Sequence[str], count_col: str,
             threshold: int = HOT_KEY_ROWS) -> DataFrame:
    """``(*keys, _fan)`` for the keys of ``counts`` with more rows than :func:`hot_limit`."""
    fan = F.expr(f"cast(({count_col} + {int(threshold) - 1}) div {int(threshold)} as int)")
    hot = counts.where(F.col(count_col) > hot_limit(counts, count_col, threshold))
    return hot.select(*keys, fan.alias("_fan"))


def skew_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
              hot: DataFrame | None = None, spread_by: Sequence[str] | None = None,
              threshold: int = HOT_KEY_ROWS) -> DataFrame:
    """``big.join(small, keys, how)`` (``inner`` or ``left``) with hot keys split.

    ``hot`` is the ``(*keys, _fan)`` table that :func:`hot_keys` makes when the caller already
    has per-key counts (its bound allows the broadcast); otherwise it is computed from
    ``big`` with one map-side-combined count.  ``spread_by`` names columns
    that identify a row of ``big`` (default: all of them).
    """
    keys = list(keys)
    if hot is None:
        hot = hot_keys(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, "_rows", threshold)
    hot = F.broadcast(hot)
    cols = list(spread_by) if spread_by else big.columns
    salt = F.when(F.col("_fan").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.col("_fan")).cast("int"))
    b = big.join(hot, keys, "left").withColumn("_salt", salt).drop("_fan")
    s = (small.join(hot, keys, "left")
         .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_fan"), F.lit(1)) - 1)))
         .drop("_fan"))
    return b.join(s, keys + ["_salt"], how).drop("_salt")
