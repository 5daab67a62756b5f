"""Materialising a derived table (the reference's ``SELECT ... INTO``)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from clickmetrics.session import checkpoint_dir


def use_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """``CREATE DATABASE`` (if missing, at ``location`` if given) and ``USE`` it."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{where}")
    spark.catalog.setCurrentDatabase(name)


def browse(df: DataFrame, n: int = 20) -> DataFrame:
    """``SELECT *`` for a look at a table: the first ``n`` rows (display only, not a metric)."""
    return df.limit(n)


def save_table(df: DataFrame, path: str | None = None, name: str | None = None,
               fmt: str = "parquet", partition_by: list[str] | None = None,
               bucket_by: tuple[int, str] | None = None) -> None:
    """Write ``df`` once so later statements read it instead of recomputing it.

    ``path`` writes files (Parquet by default); ``name`` saves a catalog table
    (stored at ``path`` when both are given), optionally bucketed by a key so
    later joins and aggregates on that key read co-located buckets without a
    shuffle.  Bucket only on keys without heavy hitters: a hot key's bucket is
    read by a single task.
    """
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if name is not None:
        if path is not None:
            w = w.option("path", path)
        if bucket_by is not None:
            n, key = bucket_by
            w = w.bucketBy(n, key).sortBy(key)
        w.saveAsTable(name)
    elif path is not None:
        w.save(path)
    else:
        raise ValueError("give a path or a table name")


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage of an expensive derived table that several metrics
    share; survives executor loss because the files live on the shared
    folder named by ``spark.checkpoint.dir``.
    """
    root = checkpoint_dir(spark)
    path = os.path.join(root, "tables", label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
