"""Key matching for a batch of requests (J4 with X2, X3, X23).

Each request presents a key text.  ``Bearer `` is stripped, ``sk-`` keys are
hashed, anything else is compared as is.  Valid requests (a key row exists) get
the key's identity; rejected ones keep only a masked prefix of what was sent.
Both sides are joins on the stored-key column; the key side is the dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costlens.functions.keys import key_prefix_mask, stored_key, strip_bearer
from costlens.operators.budgets import identities
from costlens.operators.keyspace import key_tokens


def _normalised(attempts: DataFrame) -> DataFrame:
    # A missing key becomes '' (it matches no token).  Being provably non-NULL,
    # the join key also gets no inferred IS NOT NULL filter, which Spark would
    # push below this projection and so hash every key a second time.
    key = strip_bearer(F.col("presented_key"))
    return attempts.select("request_id", key.alias("_key"),
                           F.coalesce(stored_key(key), F.lit("")).alias("api_key"))


def authenticated(attempts: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests whose key matches a key row, with user id and email."""
    n = _normalised(attempts)
    return n.join(identities(keys), "api_key", "inner").select(
        "request_id", "api_key", "user_id", "email")


def rejected(attempts: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests whose key has no key row; only a masked prefix is kept."""
    n = _normalised(attempts)
    return n.join(key_tokens(keys), "api_key", "left_anti").select(
        "request_id", key_prefix_mask(F.col("_key")).alias("key_prefix"))
