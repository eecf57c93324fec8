"""S3: idempotent append of log rows keyed by ``request_id``.

Equivalent of ``INSERT .. ON CONFLICT (request_id) DO NOTHING``.  Of copies in
one batch the one with the earliest ``startTime`` stays (equal times: the
smallest row in column order), whatever order they arrive in.  Picking it is an
aggregate, so copies are combined map-side and a request replayed millions of
times reaches the shuffle as one row per task.

The stored table is first reduced to the ids that the batch holds at all (a
semi join on the key column, which Spark runs as a broadcast or with a runtime
Bloom filter when the batch is the small side), so a load costs its batch and
one scan of a column, not a shuffle of the whole table.  Re-running a load
after a failure appends nothing twice: rows already committed are found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_copies(incoming: DataFrame, pk: str = "request_id", time: str = "startTime") -> DataFrame:
    """One row per key: the earliest, of equal times the smallest row."""
    names = incoming.columns
    order = [time, *(c for c in names if c != time)] if time in names else names
    return (incoming.groupBy(F.col(pk).alias("_pk")).agg(F.min(F.struct(*order)).alias("_row"))
            .select(*[F.col("_row")[c].alias(c) for c in names]))


def new_rows(existing: DataFrame, incoming: DataFrame, pk: str = "request_id") -> DataFrame:
    """Incoming rows whose key is neither repeated earlier in the batch nor stored."""
    ids = incoming.select(pk).distinct()
    known = existing.select(pk).join(ids, pk, "left_semi").distinct()
    return first_copies(incoming, pk).join(known, pk, "left_anti").select(*incoming.columns)


def merged(existing: DataFrame, incoming: DataFrame, pk: str = "request_id") -> DataFrame:
    """The table after the load, as a DataFrame."""
    return existing.unionByName(new_rows(existing, incoming, pk))


def append_new(existing_path: str, existing: DataFrame, incoming: DataFrame,
               pk: str = "request_id", partition_by: list[str] | None = None) -> None:
    """Append only the new rows to the table stored at ``existing_path``."""
    fresh = new_rows(existing, incoming, pk)
    w = fresh.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(existing_path)
