"""Shared helpers: reading tables, written intermediate tables, shipping this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickmetrics.session import checkpoint_dir

# The white space of every contract: space and \t \n \x0b \x0c \r.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing."""
    path = os.path.join(checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(c, _UPPER, _LOWER)


def unit_interval(*cols: Column) -> Column:
    """A number in (0, 1) drawn by hash from ``cols``: reruns and retried tasks agree."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application (``addPyFile`` of a zip), so that
    Python tasks can import it whatever folder the driver runs in."""
    sc = spark.sparkContext
    done = getattr(sc, "_clickmetrics_llm_shipped", False)
    if done:
        return
    root = Path(__file__).resolve().parent.parent
    to = os.path.join(tempfile.mkdtemp(prefix="clickmetrics-llm-"), "clickmetrics_llm.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(to)
    sc._clickmetrics_llm_shipped = True


def text_blocks(batches, column: str = "text", most: int = 4 << 20):
    """Slices of the Arrow batches with at most ``most`` bytes of text each (or one longer text)."""
    for batch in batches:
        lens = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, n in enumerate(lens.tolist()):
            if i > at and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if batch.num_rows > at:
            yield batch.slice(at)
