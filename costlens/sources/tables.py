"""Scans of the request log and the key dimension.

Parquet is read with the declared schema, so Spark neither infers nor merges
schemas; Catalyst prunes columns and pushes ``startTime`` / ``api_key``
predicates into the scan.  A JDBC reader is provided for a live PostgreSQL
log table, split into parallel range reads on ``startTime``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from costlens.schemas import SPEND_LOGS_SCHEMA, VIRTUAL_KEYS_SCHEMA


@dataclass(frozen=True)
class Tables:
    """The two inputs every report reads."""

    logs: DataFrame
    keys: DataFrame


def read_spend_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPEND_LOGS_SCHEMA).parquet(path)


def read_virtual_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VIRTUAL_KEYS_SCHEMA).parquet(path)


def read_tables(spark: SparkSession, logs_path: str, keys_path: str) -> Tables:
    return Tables(read_spend_logs(spark, logs_path), read_virtual_keys(spark, keys_path))


def read_spend_logs_jdbc(spark: SparkSession, url: str, *, table: str,
                         lower: datetime, upper: datetime, num_partitions: int,
                         properties: dict | None = None) -> DataFrame:
    """Parallel JDBC scan: ``num_partitions`` range queries on ``startTime``.

    Not exercised offline (needs a database); kept so a deployment can read the
    live table directly instead of a Parquet export.
    """
    reader = (spark.read.format("jdbc")
              .option("url", url)
              .option("dbtable", table)
              .option("partitionColumn", '"startTime"')
              .option("lowerBound", lower.isoformat(sep=" "))
              .option("upperBound", upper.isoformat(sep=" "))
              .option("numPartitions", str(num_partitions))
              .option("preferTimestampNTZ", "true"))
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    return reader.load()
