"""SparkSession construction with settings the metrics rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Settings every session should carry.  AQE re-plans at each exchange:
# coalesces small shuffle partitions, turns joins whose measured side is
# small into broadcast joins (a runtime size check), and splits skewed
# sort-merge-join partitions.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Coalesce small shuffle partitions up to the advisory size instead of
    # keeping the configured partition count: fewer, fuller tasks.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "clickmetrics", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session.  Local runs only; a cluster passes its own session."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    """The classic SparkContext, or None for a session without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions raise here
        return None


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets it (or calls ``setCheckpointDir``) to a shared file
    system, and that folder is used.  Only on a ``local`` master (tests) is a
    scratch folder created where neither is set; elsewhere executors would not
    share it, so a missing setting is an error.
    """
    sc = _context(spark)
    d = spark.conf.get("spark.checkpoint.dir", None)
    if sc is not None:
        d = sc.getConf().get("spark.checkpoint.dir", None) or d or sc.getCheckpointDir()
    if not d:
        if sc is None or not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="clickmetrics-ckpt-")
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application (``addPyFile`` of a zip), so that Python
    tasks can import it whatever folder the driver runs in."""
    sc = spark.sparkContext
    if getattr(sc, "_clickmetrics_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="clickmetrics-"), "clickmetrics.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(to)
    sc._clickmetrics_shipped = True


def cluster_conf(input_bytes: int, cores: int = 4000, partition_bytes: int = 256 << 20,
                 broadcast_bytes: int = 64 << 20) -> dict:
    """Shuffle and scan sizing for ``input_bytes`` of events on ``cores`` executor cores.

    * scans split files into ``partition_bytes`` pieces;
    * shuffles start with a few partitions per core (at least as many as keep a
      partition of a whole-input shuffle at 32 x ``partition_bytes``), so that
      map x reduce blocks stay countable; AQE then merges towards the advisory
      size and splits skewed ones;
    * runtime broadcast only for join sides *measured* below
      ``broadcast_bytes``; anything larger stays a shuffle join.
    """
    parts = max(200, 3 * int(cores), -(-int(input_bytes) // (32 * int(partition_bytes))))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(broadcast_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(broadcast_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


def _fs_path(spark: SparkSession, path: str):
    sc = _context(spark)
    if sc is None:
        return None, None
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on its file system (local, HDFS, object store)."""
    p, fs = _fs_path(spark, path)
    if fs is None:
        return os.path.exists(path)
    return bool(fs.exists(p))


def input_signature(spark: SparkSession, path: str) -> tuple:
    """A fingerprint of ``path`` that any added, removed or rewritten file changes, at any depth.

    A single file: its size and change time, one call.  A folder: number, size and latest change of all files below it
    and a hash over each one's path, size and change time, from one Spark pass over the file listing (no
    file is opened)."""
    p, fs = _fs_path(spark, path)
    if fs is None:
        st = os.stat(path)
        return (path, st.st_size, st.st_mtime_ns)
    if not fs.exists(p):
        return ()
    status = fs.getFileStatus(p)
    if status.isFile():
        return (path, int(status.getLen()), 1, int(status.getModificationTime()))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    one = files.select("path", "length", "modificationTime").agg(
        F.sum("length"), F.count(F.lit(1)), F.max(F.unix_micros("modificationTime")),
        F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return (path, *one)
