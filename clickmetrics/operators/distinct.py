"""Exact distinct counts by mergeable bitmaps (AG-3, AG-5, AG-6).

The ids of a group are bits, 64 to a word: ``id`` is bit ``id & 63`` of word ``id >> 6``.  One map-side-combined
``bit_or`` per (group, word) makes the bitmap, the sum of ``bit_count`` over its words is the distinct
count.  Against ``COUNT(DISTINCT)``:

* several distinct counts of one id (``COUNT(DISTINCT id)`` beside ``COUNT(DISTINCT CASE WHEN ... THEN id END)``) are
  several mask columns of one aggregate, where Catalyst plans an ``Expand`` that copies every row per count;
* a map task sends at most one row per word it saw: a 64th of its distinct ids where they are dense, one
  row per id where they are sparse;
* the words are a table: bitmaps of days add up to weeks, and a new day to the old ones, without the rows.

Words instead of ``bitmap_construct_agg``: its 4 KB buffer is binary, so it is a sort aggregate
that sorts every input row by bucket and sends 4 KB for a bucket with one id; ``bit_or`` on a long stays in the
generated hash aggregate, and its size follows the ids.

A group or an id that holds a third of the rows is combined before it moves; the words of one group spread over
all partitions, and the second aggregate is combined map-side too.

Ids are integers.  Others (text, sparse hashes that many counts share) are numbered once by :func:`number_ids`.
NULL ids aren't counted; a group that has only such ids counts 0; an empty table counts 0 without ``by`` and
has no groups with it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = "_word"
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def id_bitmaps(df: DataFrame, id_col: str, masks: Mapping[str, Column | None], by: Sequence[str] = (),
               counts: Mapping[str, Column] | None = None) -> DataFrame:
    """``(*by, _word, *masks, *counts)``: one bitmap per name of ``masks``, of the ids of the rows that meet its
    condition (None: all rows), and plain counts of non-null values along with them."""
    kind = dict(df.dtypes)[id_col]
    if kind not in INTEGERS:
        raise TypeError(f"{id_col} is {kind}; give it numbers by number_ids first")
    key = F.col(id_col).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(F.lit(63)).cast("int"))
    aggs = [F.bit_or(bit if cond is None else F.when(cond, bit)).alias(name) for name, cond in masks.items()]
    aggs += [F.count(c).alias(name) for name, c in (counts or {}).items()]
    return df.groupBy(*by, F.shiftright(key, 6).alias(WORD)).agg(*aggs)


def merge_bitmaps(*bitmaps: DataFrame, masks: Sequence[str], by: Sequence[str | Column] = (), counts: Sequence[str] = ()) -> DataFrame:
    """The union of bitmaps: those of several tables, or of the finer groups of one, per ``by``."""
    rows = reduce(DataFrame.unionByName, bitmaps)
    return rows.groupBy(*by, WORD).agg(*[F.bit_or(m).alias(m) for m in masks], *[F.sum(c).alias(c) for c in counts])


def count_bitmaps(bitmaps: DataFrame, masks: Sequence[str], by: Sequence[str] = (), counts: Sequence[str] = ()) -> DataFrame:
    """``(*by, *masks, *counts)`` with the number of ids of every bitmap."""
    aggs = [F.coalesce(F.sum(F.bit_count(m).cast("long")), F.lit(0)).cast("long").alias(m) for m in masks]
    aggs += [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts]
    return bitmaps.groupBy(*by).agg(*aggs)


def distinct_counts(df: DataFrame, id_col: str, masks: Mapping[str, Column | None], by: Sequence[str] = (),
                    counts: Mapping[str, Column] | None = None) -> DataFrame:
    """``COUNT(DISTINCT id)`` per name of ``masks`` (under its condition) and plain counts, per ``by``."""
    bitmaps = id_bitmaps(df, id_col, masks, by, counts)
    return count_bitmaps(bitmaps, list(masks), by, list(counts or ()))


def number_ids(spark: SparkSession, df: DataFrame, id_col: str, label: str) -> DataFrame:
    """``(id_col, number)``: the distinct non-null values of ``id_col`` with dense numbers from 0, in their order.

    Distinct values are range-partitioned and sorted, numbered inside their partition and written (under
    ``label`` in the checkpoint folder, replacing an earlier one); the offset of a partition is the running sum of one count per partition, which goes
    back to the values by a broadcast of those few thousand rows.  No task holds all values."""
    from clickmetrics.sources.sink import materialize

    values = df.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    at = F.monotonically_increasing_id()
    placed = values.repartitionByRange(id_col).sortWithinPartitions(id_col).select(
        id_col, F.shiftrightunsigned(at, 33).cast("int").alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    placed = materialize(spark, placed, label)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").select(id_col, (F.col("_before") + F.col("_at")).alias("number"))
