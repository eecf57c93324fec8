"""Physical layout of the request log for range and key lookups.

The reference relies on B-tree indexes on (api_key, startTime) and
(startTime, api_key, model).  On Parquet the same lookups are served by:

* ``day`` partition folders (S6): a time-range report reads only the folders
  of its days (partition pruning), and
* inside each day, rows range-partitioned and sorted by (api_key, startTime)
  (S5): every file / row group covers a narrow api_key range, so a one-key
  filter skips most of them from the Parquet min/max statistics.

Range partitioning on (day, api_key, startTime) also splits a hot key over
several files, because ``startTime`` is part of the range key, so no writer
task has to take one key's whole day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.schemas import SPEND_LOGS_SCHEMA

LAYOUT_SCHEMA = T.StructType(SPEND_LOGS_SCHEMA.fields + [T.StructField("day", T.DateType(), True)])


def write_log_layout(logs: DataFrame, path: str, num_partitions: int | None = None,
                     mode: str = "overwrite", row_group_bytes: int | None = None) -> None:
    """Write ``logs`` partitioned by day and sorted by (api_key, startTime).

    A Bloom filter on ``api_key`` in every row group lets a one-key read skip
    groups whose key range spans the key without holding it.
    ``row_group_bytes`` sets the size of a row group (Parquet's default if None).
    """
    df = logs.withColumn("day", F.to_date("startTime"))
    keys = ["day", "api_key", "startTime"]
    df = (df.repartitionByRange(num_partitions, *keys) if num_partitions
          else df.repartitionByRange(*keys))
    out = (df.sortWithinPartitions(*keys).write.mode(mode).option("partitionOverwriteMode", "dynamic")
           .option("parquet.bloom.filter.enabled#api_key", "true"))
    if row_group_bytes:
        out = out.option("parquet.block.size", str(row_group_bytes))
    out.partitionBy("day").parquet(path)


def read_log_layout(spark: SparkSession, path: str) -> DataFrame:
    """The laid-out log; ``day`` is a partition column that reports filter on."""
    return spark.read.schema(LAYOUT_SCHEMA).parquet(path)
