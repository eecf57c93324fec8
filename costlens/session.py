"""Session for tests and the bench, plus the shared working folder.

Library operators never change session settings.  Jobs that must write
(stream checkpoints, rollup tables, lineage cuts) use a folder under the
cluster's shared ``spark.checkpoint.dir``; only a local session without that
setting gets a fresh temporary folder, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "costlens", extra: dict[str, str] | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               # Skip per-call Python call-site capture (error context only); it
               # costs several JVM round trips for every Column function call.
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.driver.memory", os.environ.get("COSTLENS_DRIVER_MEMORY", "8g")))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a temporary one only when unset (local runs)."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        # SparkContext adds a per-application sub folder; keep using it.
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(root)
            root = sc.getCheckpointDir()
        return root
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    root = tempfile.mkdtemp(prefix="costlens-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh, uniquely named folder under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/costlens/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark reads; nothing happens if it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
