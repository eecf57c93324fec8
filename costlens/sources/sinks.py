"""Report sinks: flat Parquet (primary), CSV, and nested JSON header + list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nested(rows: DataFrame, header: list[str], list_name: str, item_cols: list[str],
           order: list[Column], universe: DataFrame | None = None) -> DataFrame:
    """One row per header with the report's items as an array of structs.

    ``order`` gives the sort values, ascending (negate a number for largest
    first).  ``universe`` holds the headers that must appear; one without rows
    gets an empty list.  The list per key is bounded by the report's grain
    (models, projects or days of one period), so it never gathers an unbounded
    group.
    """
    keys = [k.alias(f"k{i}") for i, k in enumerate(order)]
    items = F.struct(F.struct(*keys).alias("key"), F.struct(*item_cols).alias("item"))
    out = rows.groupBy(*header).agg(F.sort_array(F.collect_list(items)).alias("sorted"))
    if universe is not None:
        out = universe.select(*header).distinct().join(out, header, "left")
    listed = F.transform("sorted", lambda x: x["item"])
    empty = F.array().cast(rows.select(F.array(F.struct(*item_cols)).alias("items")).schema["items"].dataType)
    return out.select(*header, F.coalesce(listed, empty).alias(list_name))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Comma-separated with a header in every file, quotes doubled; a null is an empty field, an empty text is ``""``.

    Nested columns cannot be written; lay them flat first.  Times are written in
    UTC wall clock with microseconds, so reading them back needs no session zone.
    """
    (df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", '""')
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What :func:`write_csv` wrote, with its declared schema."""
    mark = "\0"  # what the reader puts for "", which it would else take for a null
    rows = (spark.read.schema(schema).option("header", True).option("escape", '"').option("emptyValue", mark)
            .option("multiLine", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return rows.withColumns({c: F.when(F.col(c) == mark, F.lit("")).otherwise(F.col(c)) for c in texts})


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
