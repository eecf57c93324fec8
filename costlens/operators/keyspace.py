"""Joins against the key dimension.

Reports aggregate log rows first and join the (much smaller) aggregate to the
key table; because ``token`` is the key table's primary key this is exact
(SURVEY J1).

No hint is given: Spark broadcasts the key side when its size is below
``spark.sql.autoBroadcastJoinThreshold`` and AQE re-plans from measured sizes;
a large key table gets a sort-merge join on aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_tokens(keys: DataFrame) -> DataFrame:
    return keys.select(F.col("token").alias("api_key"))


def only_valid_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Keep rows whose api_key has a key row (the keys a client can present)."""
    return df.join(key_tokens(keys), "api_key", "left_semi")


def with_alias(df: DataFrame, keys: DataFrame) -> DataFrame:
    """LEFT join; rows of deleted/unknown keys keep a NULL alias."""
    side = keys.select(F.col("token").alias("api_key"), "key_alias")
    return df.join(side, "api_key", "left")
