"""Hits stored by day, so that a date range reads only its folders (FL-4).

:func:`write_by_date` keeps ``event_date``, the day of the hit's time, as the partition column of the files.  A range on
the time itself prunes no folder (Spark doesn't derive one column's bounds from another's), so :func:`pruned`
states the days that a range touches; the exact filter on the time stays with the operator.  A day at the
edge of a range is read whole and filtered; a session over midnight has its hits in two folders and its one row in
the session table, and is grouped by its id as before.

Rows come to their day by ``REBALANCE``: adaptive execution splits a day beyond the advisory partition size along
map outputs and merges small ones, so a day with a third of all hits is written by many tasks.  Inside a file rows
are in time order, so that the row groups of an edge day are skipped by their bounds.  Hits without a time are in a folder
of their own, which no range reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickmetrics.functions.compat import ntz

DATE = "event_date"


def write_by_date(df: DataFrame, path: str, ts: str, row_group_bytes: int) -> None:
    """``df`` as Parquet folders by day of ``ts``, replacing what is at ``path``."""
    dated = df.withColumn(DATE, F.to_date(ts)).hint("rebalance", DATE)
    (dated.sortWithinPartitions(DATE, ts).write.mode("overwrite").option("parquet.block.size", row_group_bytes)
     .partitionBy(DATE).parquet(path))


def pruned(dated: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The rows of the days that ``start <= time <= end`` touches (both are time texts), without ``event_date``."""
    if start is not None:
        dated = dated.where(F.col(DATE) >= F.to_date(ntz(start)))
    if end is not None:
        dated = dated.where(F.col(DATE) <= F.to_date(ntz(end)))
    return dated.drop(DATE)
