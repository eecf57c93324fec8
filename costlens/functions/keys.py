"""Key text handling and identity."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# The raw-key prefix that marks an unhashed virtual key, and the
# HTTP authorization prefix (7 characters, case-sensitive).
RAW_KEY_PREFIX = "sk-"
BEARER_PREFIX = "Bearer "


def hash_token(c: Column) -> Column:
    """Lower-case SHA-256 hex digest, as stored in the key table."""
    return F.sha2(c, 256)


def stored_key(c: Column) -> Column:
    """Hash only keys that start with ``sk-``; other text is used as is."""
    return F.when(c.startswith(RAW_KEY_PREFIX), hash_token(c)).otherwise(c)


def strip_bearer(c: Column) -> Column:
    """Drop a leading ``Bearer `` (exactly that case)."""
    return F.when(c.startswith(BEARER_PREFIX),
                  F.substring(c, len(BEARER_PREFIX) + 1, 1 << 30)).otherwise(c)


def stored_key_text(key: str) -> str:
    """Driver-side X3 + X2 for a single key, so the filter becomes a literal."""
    if key.startswith(BEARER_PREFIX):
        key = key[len(BEARER_PREFIX):]
    if key.startswith(RAW_KEY_PREFIX):
        return hashlib.sha256(key.encode()).hexdigest()
    return key


def email_from_metadata(metadata: Column) -> Column:
    """``email``, else ``user_email``; empty, malformed or non-object JSON -> NULL."""
    def field(name: str) -> Column:
        return F.nullif(F.get_json_object(metadata, f"$.{name}"), F.lit(""))
    return F.coalesce(field("email"), field("user_email"))


def identity_id(user_id: Column, token: Column) -> Column:
    """The key's user_id, else the first 16 characters of the token."""
    return F.coalesce(F.nullif(user_id, F.lit("")), F.substring(token, 1, 16))


def identity_email(email: Column, ident: Column) -> Column:
    """Fallback ``<id>@unknown``."""
    return F.coalesce(email, F.concat(ident, F.lit("@unknown")))


def key_prefix_mask(c: Column) -> Column:
    """First 10 characters followed by ``...`` (safe to log)."""
    return F.concat(F.substring(c, 1, 10), F.lit("..."))
