"""SparkSession construction and the shared scratch location."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "retentio") -> SparkSession:
    """Session with the settings every query here assumes.

    * UTC session zone: the order timestamps are zone-less and dates are cut
      from the ISO text, never shifted.
    * AQE on: runtime partition coalescing, skew-join splitting and runtime
      broadcast conversion for joins whose small side is not known up front.
    * ANSI stays on (Spark 4 default); operators use ``try_*`` where the
      reference turns bad input into NA instead of failing.
    """
    master = master or os.environ.get("RETENTIO_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master.startswith("local"):
        # Local mode runs every executor thread inside the driver JVM, so its
        # heap is the executors' memory; the 1g default is far too small for
        # 8 threads aggregating millions of rows.  (Applies when this call
        # launches the JVM; a cluster sizes executors through its own conf.)
        builder = builder.config("spark.driver.memory",
                                 os.environ.get("RETENTIO_DRIVER_MEMORY", "16g"))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a shared file system every executor can
    reach).  Only a local-mode session without the setting, as in tests, gets
    a fresh private folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="retentio-ckpt-"))
    return sc.getCheckpointDir()


_scratch: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the checkpoint root for a written table.

    DataFrames read these tables lazily, so they stay until the program ends
    (or ``drop_scratch`` is called) and are then removed."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/retentio-{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(drop_scratch)
    _scratch.append((spark, path))
    return path


def drop_scratch() -> None:
    """Remove the scratch tables of this program; a stopped session's are left
    to the folder's own retention."""
    while _scratch:
        spark, path = _scratch.pop()
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
