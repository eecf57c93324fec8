"""Readers with declared schemas, sinks, and the nested report."""

import json

from pyspark.sql import functions as F

from costlens.operators import breakdowns
from costlens.session import work_dir
from costlens.sources.sinks import nested, write_json, write_parquet
from costlens.sources.tables import read_tables
from costlens.sources.testdata import load_tables
from tests.conftest import AS_OF, SF0001, rows


def test_parquet_round_trip_with_declared_schema(spark):
    t = load_tables(spark, SF0001)
    root = work_dir(spark, "t-src")
    write_parquet(t.logs, f"{root}/logs", partition_by=None)
    write_parquet(t.keys, f"{root}/keys")
    back = read_tables(spark, f"{root}/logs", f"{root}/keys")
    assert back.logs.schema.simpleString() == t.logs.schema.simpleString()
    assert rows(breakdowns.by_model(back, AS_OF, "month")) == rows(breakdowns.by_model(t, AS_OF, "month"))


def test_nested_report_explodes_back_to_the_flat_report(spark):
    t = load_tables(spark, SF0001)
    flat = breakdowns.by_model(t, AS_OF, "month")
    cols = ["model", "spend", "percentage", "requests", "tokens", "prompt_tokens", "completion_tokens"]
    nest = nested(flat, ["api_key", "period"], "models", cols, [-F.col("spend"), F.col("model")])
    assert nest.count() == flat.select("api_key").distinct().count()
    back = nest.select("api_key", "period", F.explode("models").alias("m")).select(
        "api_key", "period", *[F.col(f"m.{c}").alias(c) for c in cols])
    assert rows(back) == rows(flat.select("api_key", "period", *cols))
    # items are sorted inside each list, largest spend first
    for r in nest.collect():
        items = [(-m["spend"], m["model"]) for m in r["models"]]
        assert items == sorted(items)
    out = work_dir(spark, "t-json")
    write_json(nest, out)
    first = json.loads(spark.read.text(out).first()[0])
    assert set(first) == {"api_key", "period", "models"} and "percentage" in first["models"][0]


def test_nested_reports_have_an_empty_list_for_a_valid_key_without_rows(spark):
    from costlens.plans.catalog import nested_reports
    from tests.conftest import key_row, log_row, make_tables, sha
    t = make_tables(spark, [log_row(sha("sk-1"), "2024-01-05 10:00:00", 1.0, model="a"),
                            log_row(sha("sk-1"), "2024-01-06 10:00:00", 9.0, model="z")],
                    [key_row(sha("sk-1")), key_row(sha("sk-2"))])
    for name, df in nested_reports(t, AS_OF, "month").items():
        got = {r["api_key"]: r["items"] for r in df.collect()}
        assert got[sha("sk-2")] == [] and len(got) == 2, name
        if name == "by_model":
            assert [m["model"] for m in got[sha("sk-1")]] == ["z", "a"]
        if name == "daily":
            assert [m["spend"] for m in got[sha("sk-1")]] == [9.0, 1.0]


def test_append_new_keeps_the_earliest_copy_and_is_safe_to_repeat(spark):
    from costlens.schemas import SPEND_LOGS_SCHEMA
    from costlens.sources.load import append_new
    from tests.conftest import log_row, make_tables, sha
    path = work_dir(spark, "t-append") + "/logs"
    k = sha("sk-1")
    old = make_tables(spark, [log_row(k, "2024-01-01 10:00:00", 1.0, request_id="a")], []).logs
    batch = make_tables(spark, [log_row(k, "2024-01-02 10:00:00", 5.0, request_id="a"),
                                log_row(k, "2024-01-03 11:00:00", 3.0, request_id="b"),
                                log_row(k, "2024-01-03 10:00:00", 2.0, request_id="b")], []).logs
    write_parquet(old, path)
    for _ in range(2):
        append_new(path, spark.read.schema(SPEND_LOGS_SCHEMA).parquet(path), batch)
        assert rows(spark.read.schema(SPEND_LOGS_SCHEMA).parquet(path), "request_id", "spend") == [("a", 1.0), ("b", 2.0)]
