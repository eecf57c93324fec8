"""Declared schemas of the two input tables (nothing is inferred)."""

from pyspark.sql import types as T

SPEND_LOGS_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType(), False),
    T.StructField("api_key", T.StringType(), False),
    T.StructField("user", T.StringType(), True),
    T.StructField("model", T.StringType(), True),
    T.StructField("spend", T.DoubleType(), False),
    T.StructField("total_tokens", T.IntegerType(), False),
    T.StructField("prompt_tokens", T.IntegerType(), False),
    T.StructField("completion_tokens", T.IntegerType(), False),
    T.StructField("call_type", T.StringType(), True),
    T.StructField("cache_hit", T.StringType(), True),
    T.StructField("cache_key", T.StringType(), True),
    T.StructField("metadata", T.StringType(), True),
    T.StructField("startTime", T.TimestampNTZType(), False),
    T.StructField("endTime", T.TimestampNTZType(), False),
])

VIRTUAL_KEYS_SCHEMA = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("key_alias", T.StringType(), True),
    T.StructField("spend", T.DoubleType(), False),
    T.StructField("max_budget", T.DoubleType(), True),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("team_id", T.StringType(), True),
    T.StructField("models", T.StringType(), True),
    T.StructField("metadata", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("expires", T.TimestampNTZType(), True),
    T.StructField("budget_duration", T.StringType(), True),
    T.StructField("budget_id", T.StringType(), True),
    T.StructField("budget_reset_at", T.TimestampNTZType(), True),
    T.StructField("budget_limits", T.StringType(), True),
    T.StructField("model_max_budget", T.StringType(), True),
    T.StructField("soft_budget_cooldown", T.BooleanType(), True),
])

# Measures carried by every breakdown row.
MEASURES = ("spend", "requests", "tokens", "prompt_tokens", "completion_tokens")
