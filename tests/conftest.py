from __future__ import annotations

import hashlib
import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from costlens.schemas import SPEND_LOGS_SCHEMA, VIRTUAL_KEYS_SCHEMA  # noqa: E402
from costlens.session import local_session  # noqa: E402
from costlens.sources.tables import Tables  # noqa: E402

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"
AS_OF = datetime(2024, 1, 17, 15, 30, 0)


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="costlens-tests")
    yield s
    s.stop()


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_n = [0]


def log_row(key: str, ts: str, spend: float, model="gpt-4", prompt=80, completion=20,
            request_id: str | None = None) -> dict:
    _n[0] += 1
    return {
        "request_id": request_id or f"r{_n[0]}", "api_key": key, "user": None, "model": model,
        "spend": float(spend), "total_tokens": prompt + completion, "prompt_tokens": prompt,
        "completion_tokens": completion, "call_type": None, "cache_hit": None, "cache_key": None,
        "metadata": None, "startTime": datetime.fromisoformat(ts),
        "endTime": datetime.fromisoformat(ts),
    }


def key_row(token: str, max_budget=None, alias=None, user_id=None, metadata=None) -> dict:
    row = {f.name: None for f in VIRTUAL_KEYS_SCHEMA.fields}
    row.update(token=token, key_alias=alias, spend=0.0,
               max_budget=None if max_budget is None else float(max_budget),
               user_id=user_id, metadata=metadata, created_at=datetime(2023, 12, 1))
    return row


def make_tables(spark, logs: list[dict], keys: list[dict]) -> Tables:
    ldf = spark.createDataFrame([tuple(r[f.name] for f in SPEND_LOGS_SCHEMA.fields) for r in logs],
                                SPEND_LOGS_SCHEMA)
    kdf = spark.createDataFrame([tuple(r[f.name] for f in VIRTUAL_KEYS_SCHEMA.fields) for r in keys],
                                VIRTUAL_KEYS_SCHEMA)
    return Tables(ldf, kdf)


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
