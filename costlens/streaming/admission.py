"""Event-time admission: rows dated ahead of their arrival do not enter the stream.

The watermark follows the latest event time.  One row with a wrong clock, years
ahead, would push it past all rows to come, which would then count as late.  So
a row is admitted only if it is dated at most ``tolerance`` after the moment it
was landed (the modification time of its file, the same on every retry).  All
others go to the quarantine table, by a query of their own with exactly-once
file output, and come back with :func:`readmit` once their time has come or
with a corrected time.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from costlens.files import Files
from costlens.functions.time import event_instant
from costlens.schemas import SPEND_LOGS_SCHEMA

TOLERANCE = "1 hour"
QUARANTINE_SCHEMA = T.StructType([*SPEND_LOGS_SCHEMA.fields, T.StructField("received", T.TimestampType(), True)])
#: What tells quarantined rows apart; the marks of readmitted ones hold it.
MARK = ("request_id", "startTime", "received")


def instant(at: datetime) -> Column:
    """A naive-UTC clock reading as an instant, session-zone free."""
    since = at.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(since.days * 86_400_000_000 + since.seconds * 1_000_000 + since.microseconds))


def received(landed: DataFrame, clock: datetime | None = None) -> DataFrame:
    """Landed rows with their arrival: that of the file, or ``clock`` for a replay of old logs."""
    at = F.col("_metadata.file_modification_time") if clock is None else instant(clock)
    return landed.select(*[f.name for f in SPEND_LOGS_SCHEMA.fields], at.alias("received"))


def early(tolerance: str = TOLERANCE) -> Column:
    return event_instant(F.col("startTime")) > F.col("received") + F.expr(f"INTERVAL {tolerance}")


def admitted(landed: DataFrame, tolerance: str = TOLERANCE, clock: datetime | None = None) -> DataFrame:
    return received(landed, clock).where(~early(tolerance)).drop("received")


def quarantine_writer(landed: DataFrame, root: str, checkpoint: str, tolerance: str = TOLERANCE,
                      clock: datetime | None = None) -> DataStreamWriter:
    """The query that files the rows not admitted."""
    return (received(landed, clock).where(early(tolerance)).writeStream.format("parquet").outputMode("append")
            .option("path", f"{root}/quarantine").option("checkpointLocation", f"{checkpoint}-quarantine"))


def _stored(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    if not any(not n.startswith((".", "_SUCCESS")) for n in Files(spark, root).names(name)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def quarantined(spark: SparkSession, root: str) -> DataFrame:
    """Rows that wait in quarantine, with their arrival."""
    marks = T.StructType([f for f in QUARANTINE_SCHEMA.fields if f.name in MARK])
    return (_stored(spark, root, "quarantine", QUARANTINE_SCHEMA)
            .join(_stored(spark, root, "readmitted", marks).distinct(), list(MARK), "left_anti").select(*QUARANTINE_SCHEMA.names))


def readmit(spark: SparkSession, root: str, landing: str, now: datetime, tolerance: str = TOLERANCE,
            at: Column | None = None) -> None:
    """Land waiting rows again: those due at ``now``, or all with the corrected ``startTime`` ``at``.

    The rows are landed before they are marked.  If the job dies in between
    they land twice, and the stream counts a request id once.
    """
    waiting = quarantined(spark, root)
    if at is None:
        rows = waiting.where(event_instant(F.col("startTime")) <= instant(now) + F.expr(f"INTERVAL {tolerance}"))
        landed = rows
    else:
        rows = waiting
        landed = rows.withColumns({"startTime": at.cast("timestamp_ntz"), "endTime": at.cast("timestamp_ntz") + (F.col("endTime") - F.col("startTime"))})
    rows = rows.select(*MARK).persist()  # the marks are of the rows as they were before landing
    try:
        rows.count()
        landed.select(*SPEND_LOGS_SCHEMA.names).write.mode("append").parquet(landing)
        rows.write.mode("append").parquet(f"{root}/readmitted")
    finally:
        rows.unpersist()
