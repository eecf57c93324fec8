"""Team totals, and an amount shared out over teams, users and keys to the last cent.

An amount (an invoice, or the log's own total) is apportioned by the largest
remainder: each part gets the whole cents of its proportional share, and the
cents that are left go to the parts with the largest remainders, equal ones by
name.  Teams share the amount, the users of a team its share, the keys of a user
theirs, so every level adds up exactly.  All arithmetic is on integers.

Which parts get a cent more is decided by their position in their group.
Positions come from one range-partitioned sort of all parts (:func:`positions`),
not from a window per group, so a team that holds a third of all keys is spread
over tasks like any other rows.
"""

from __future__ import annotations

from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costlens.config import DEFAULT_CONFIG, ReportConfig
from costlens.operators.breakdowns import period_facts, spend_by_key
from costlens.operators.facts import Rollup, money_out, sum_measures
from costlens.periods import Period
from costlens.sources.tables import Tables

#: Name of what a key without a team, user or key row belongs to; places of the money shared out and of the weights.
UNASSIGNED = "unassigned"
CENTS, WEIGHT_PLACES = 2, 8
WHOLE = "decimal(38,0)"


def owners(keys: DataFrame) -> DataFrame:
    """``(api_key, team, user)`` of every key row."""
    def named(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(UNASSIGNED))

    return keys.select(F.col("token").alias("api_key"), named("team_id").alias("team"), named("user_id").alias("user"))


def _with_owner(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(owners(keys), "api_key", "left").fillna(UNASSIGNED, ["team", "user"])


def team_totals(tables: Tables, as_of: datetime, period=Period.MONTH, cfg: ReportConfig = DEFAULT_CONFIG,
                rollup: Rollup | None = None) -> DataFrame:
    """Spend, requests and tokens per team, with the number of its keys and users that have rows."""
    sums = period_facts(tables, as_of, period, cfg, rollup).groupBy("api_key").agg(*sum_measures("spend", "requests", "tokens"))
    users = _with_owner(sums, tables.keys).groupBy("team", "user").agg(F.count("api_key").alias("keys"), *sum_measures("spend", "requests", "tokens"))
    teams = users.groupBy("team").agg(F.count("user").alias("users"), F.sum("keys").alias("keys"), *sum_measures("spend", "requests", "tokens"))
    return money_out(teams).select("team", "users", "keys", "spend", "requests", "tokens")


def positions(rows: DataFrame, group: list[str], order: list[Column], folder: str) -> DataFrame:
    """``rows`` with their ``position`` (from 1) in their group by ``order``, without a task per group.

    The rows are range-partitioned and sorted by group and order, and written to
    ``folder``, which fixes the tasks.  A row's position is its place in its task
    plus the group's rows in earlier tasks.  Groups must not be null.
    """
    keys = [*map(F.col, group), *order]
    placed = (rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    placed.write.mode("overwrite").parquet(folder)
    stored = rows.sparkSession.read.schema(placed.schema).parquet(folder)
    blocks = stored.groupBy(*group, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return (stored.join(blocks, [*group, "_task"])
            .withColumn("position", F.col("_before") + F.col("_at") - F.col("_first") + 1)
            .drop("_task", "_at", "_first", "_n", "_before"))


def apportioned(parts: DataFrame, wholes: DataFrame, group: list[str], name: str, folder: str) -> DataFrame:
    """``parts (group.., name, weight)`` with ``amount``: the shares of ``wholes (group.., amount)``, which add up to it.

    Weights are integers of 0 or more; if all of a group are 0, its parts count alike.
    """
    sums = parts.groupBy(*group).agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("parts"))
    sums = sums.join(wholes.select(*group, F.col("amount").alias("whole")), group)
    none = F.col("total") == 0
    quota = (parts.join(sums, group)
             .withColumns({"weight": F.when(none, F.lit(1)).otherwise(F.col("weight")).cast(WHOLE),
                           "total": F.when(none, F.col("parts")).otherwise(F.col("total")).cast(WHOLE)})
             .withColumn("product", F.col("whole").cast("decimal(19,0)") * F.col("weight").cast("decimal(28,0)"))
             .withColumn("base", F.expr("product div total"))
             .withColumn("remainder", (F.col("product") - F.col("base").cast("decimal(19,0)") * F.col("total").cast("decimal(28,0)")).cast(WHOLE)))
    placed = positions(quota.select(*group, name, "whole", "base", "remainder"), group, [F.desc("remainder"), F.col(name)], folder)
    left = placed.groupBy(*group).agg((F.max("whole") - F.sum("base")).alias("left"))
    more = (F.col("position") <= F.col("left")).cast("long")
    return placed.join(left, group).select(*group, name, (F.col("base") + more).alias("amount"))


def cost_allocation(tables: Tables, as_of: datetime, period, folder: str, amount: Decimal | None = None,
                    cfg: ReportConfig = DEFAULT_CONFIG, rollup: Rollup | None = None) -> DataFrame:
    """``(team, user, api_key, spend, allocated, user_allocated, team_allocated)``.

    ``amount`` is shared out in proportion to spend (negative spend counts as
    none); by default it is the log's total, to the cent.  ``folder`` takes the
    intermediate tables.
    """
    spark = tables.logs.sparkSession
    sums = _with_owner(spend_by_key(tables, as_of, period, cfg, rollup), tables.keys)
    weight = F.greatest(F.round(F.coalesce("spend", F.lit(0)), WEIGHT_PLACES) * F.lit(10 ** WEIGHT_PLACES), F.lit(0)).cast(WHOLE)
    sums.withColumn("weight", weight).write.mode("overwrite").parquet(f"{folder}/spend")
    keys = spark.read.parquet(f"{folder}/spend").withColumn("book", F.lit("spend"))
    if amount is None:
        amount = keys.agg(F.sum("spend")).first()[0] or Decimal(0)
    cents = int((amount.quantize(Decimal(1).scaleb(-CENTS), ROUND_HALF_UP)).scaleb(CENTS))
    levels, group = {}, ["book"]
    wholes = spark.createDataFrame([("spend", cents)], "book string, amount bigint")
    for name in ("team", "user", "api_key"):
        parts = keys.groupBy(*group, name).agg(F.sum("weight").alias("weight"))
        wholes = levels[name] = apportioned(parts, wholes, group, name, f"{folder}/{name}")
        group = [*group, name]

    def money(level: str, out: str) -> DataFrame:
        shares = levels[level]
        in_units = (F.col("amount").cast("decimal(30,0)") / F.lit(10 ** CENTS)).cast(f"decimal(30,{CENTS})")
        return shares.withColumn(out, in_units).drop("book", "amount")

    out = (keys.select("team", "user", "api_key", "spend").join(money("api_key", "allocated"), ["team", "user", "api_key"])
           .join(money("user", "user_allocated"), ["team", "user"]).join(money("team", "team_allocated"), ["team"]))
    return money_out(out).select("team", "user", "api_key", "spend", "allocated", "user_allocated", "team_allocated")
