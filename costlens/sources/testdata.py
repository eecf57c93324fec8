"""Stand-in inputs built from the driver's test tables.

These functions only shape rows into the schemas the jobs expect; they do none
of the reports' work.  Derivation (documented in FIXTURES.md):

* ``spend_logs`` from ``events``: one log row per event.  The key is the
  SHA-256 of ``sk-user-<user_id>``; the model text cycles through NULL, empty,
  provider-prefixed and bare names so every normaliser branch is hit.
* ``virtual_keys`` from ``customer``: one key per customer except every 11th,
  so some log keys have no key row (orphans for the LEFT JOIN).
* ``auth_attempts`` from ``events``: the key text each request presented,
  in the forms a client may send (with/without ``Bearer ``, raw or hashed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.schemas import SPEND_LOGS_SCHEMA, VIRTUAL_KEYS_SCHEMA
from costlens.sources.tables import Tables


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _typed(columns: dict, schema) -> list:
    """One typed column per schema field (missing ones are typed NULLs)."""
    return [(columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields]


def raw_key(user_col: Column) -> Column:
    return F.concat(F.lit("sk-user-"), user_col.cast("string"))


def spend_logs_from_events(events: DataFrame) -> DataFrame:
    eid, uid, etype = F.col("event_id"), F.col("user_id"), F.col("event_type")
    m = eid % 10
    model = (F.when(m == 0, F.lit(None).cast("string"))
             .when(m == 1, F.lit(""))
             .when(m == 2, F.lit("openai/"))
             .when(m == 3, F.concat(F.lit("azure/openai/"), etype))
             .when(m == 4, F.concat(F.lit("openai/"), etype))
             .when(m == 5, F.concat(F.lit("anthropic/"), etype))
             .otherwise(etype))
    u = uid % 5
    user = (F.when(u == 0, F.lit(None).cast("string"))
            .when(u == 1, F.lit("default_user_id"))
            .otherwise(F.concat(F.lit("user-"), uid.cast("string"))))
    # The integer ``k`` of ``props`` (e.g. {"k": 69}); a regex is ~3x cheaper per
    # row than a JSON parse and reads the same value.
    prompt = F.coalesce(F.regexp_extract("props", r'"k"\s*:\s*(-?\d+)', 1).try_cast("int"),
                        F.lit(0))
    completion = (eid % 50).cast("int")
    return events.select(*_typed({
        "request_id": F.concat(F.lit("req-"), eid.cast("string")),
        # Non-NULL by schema; coalesce lets Spark see that, so join-inferred
        # IS NOT NULL filters fold away instead of hashing every row twice.
        "api_key": F.coalesce(F.sha2(raw_key(uid), 256), F.lit("")),
        "user": user,
        "model": model,
        "spend": F.when(uid % 13 == 0, F.lit(0.0)).otherwise(F.col("value")),
        "total_tokens": prompt + completion,
        "prompt_tokens": prompt,
        "completion_tokens": completion,
        "metadata": F.col("props"),
        "startTime": F.col("ts"),
        "endTime": F.col("ts") + F.expr("INTERVAL 5 SECONDS"),
    }, SPEND_LOGS_SCHEMA))


def virtual_keys_from_customer(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    ks = k.cast("string")
    meta = (F.when(k % 5 == 0, F.concat(F.lit('{"email": "e'), ks, F.lit('@x.io"}')))
            .when(k % 5 == 1, F.concat(F.lit('{"user_email": "u'), ks, F.lit('@x.io"}')))
            .when(k % 5 == 2, F.lit('{"email": ""}'))
            .when(k % 5 == 3, F.lit("{broken"))
            .otherwise(F.lit(None).cast("string")))
    budget = (F.when(k % 10 == 0, F.lit(None).cast("double"))
              .when(k % 10 == 1, F.lit(0.0))
              .otherwise(F.lit(40.0) * (k % 150 + 1)))
    return customer.where(k % 11 != 0).select(*_typed({
        "token": F.coalesce(F.sha2(raw_key(k), 256), F.lit("")),
        "key_alias": F.when(k % 4 == 0, F.lit("engineering")).otherwise(F.col("c_name")),
        "spend": F.lit(0.0),
        "max_budget": budget,
        "user_id": F.when(k % 6 == 0, F.lit(None)).otherwise(F.concat(F.lit("user-"), ks)),
        "metadata": meta,
        "created_at": F.lit("2023-12-01 00:00:00"),
    }, VIRTUAL_KEYS_SCHEMA))


def auth_attempts_from_events(events: DataFrame) -> DataFrame:
    """(request_id, presented_key): the key text sent with each request.

    The form depends on the event type: ``Bearer sk-..``, bare ``sk-..``, the
    stored hash itself, ``Bearer <hash>``, or a revoked ``sk-`` key that has no
    key row.
    """
    uid, etype = F.col("user_id"), F.col("event_type")
    sk = raw_key(uid)
    presented = (F.when(etype == "click", F.concat(F.lit("Bearer "), sk))
                 .when(etype == "view", sk)
                 .when(etype == "purchase", F.sha2(sk, 256))
                 .when(etype == "signup", F.concat(F.lit("Bearer "), F.sha2(sk, 256)))
                 .otherwise(F.concat(F.lit("sk-revoked-"), uid.cast("string"))))
    return events.select(
        F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
        presented.alias("presented_key"),
    )


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The two stand-in tables of ``sf_dir`` (lazy plans)."""
    return Tables(
        logs=spend_logs_from_events(_read(spark, sf_dir, "events")),
        keys=virtual_keys_from_customer(_read(spark, sf_dir, "customer")),
    )


def faulty_tables(t: Tables) -> Tables:
    """Tables that break rules, as input for validation: some negative and some
    missing spends, and every key whose token begins with 0 stored twice."""
    last = F.substring(F.col("request_id"), -1, 1)
    spend = (F.when(F.col("request_id").endswith("013"), F.lit(None).cast("double"))
             .when(last == "7", -F.col("spend")).otherwise(F.col("spend")))
    return Tables(t.logs.withColumn("spend", spend),
                  t.keys.unionByName(t.keys.where(F.col("token").startswith("0"))))


def with_teams(t: Tables) -> Tables:
    """Keys of 17 teams; every ninth key has none."""
    n = F.coalesce(F.regexp_extract("key_alias", r"(\d+)$", 1).try_cast("int"), F.length(F.coalesce("user_id", F.lit("")))) % 17
    team = F.when(F.substring("token", 1, 1) == "0", F.lit(None)).otherwise(F.concat(F.lit("team-"), n.cast("string")))
    return Tables(t.logs, t.keys.withColumn("team_id", team))


def spiked(t: Tables) -> Tables:
    """Spend two hundred times as high in requests whose number ends in 77, and none on every sixth day."""
    spend = (F.when(F.dayofmonth("startTime") % 6 == 0, F.lit(0.0))
             .when(F.col("request_id").endswith("77"), F.col("spend") * 200).otherwise(F.col("spend")))
    return Tables(t.logs.withColumn("spend", spend), t.keys)


def load_period_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, period)``: the period text of each request, some of them wrong, empty or missing."""
    texts = F.array(*[F.lit(x) for x in ("today", "week", "month", "Month", "", None, "year ", "week")])
    return _read(spark, sf_dir, "events").select(F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
                                                 F.get(texts, (F.col("event_id") % 8).cast("int")).alias("period"))


def load_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(currency, day, rate)``: dated rates made from each day's number of events.

    USD on days 1, 4, 7.., GBP on days 2, 7, 12.., JPY from the ninth day on.
    """
    per_day = _read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    rate = ((F.lit(500) + F.col("n") % 1000).cast("decimal(12,6)") / F.lit(1000)).cast("decimal(12,6)")
    d = F.dayofmonth("day")
    given = [(d % 3 == 1, "USD"), (d % 5 == 2, "GBP"), ((d >= 9) & (d % 2 == 1), "JPY")]
    named = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in given])))
    return per_day.select(named.alias("currency"), "day", rate.alias("rate"))


def misdated(logs: DataFrame) -> DataFrame:
    """Requests whose number ends in 13 dated twenty years ahead, as by a wrong clock."""
    def moved(c: str):
        return F.when(F.col("request_id").endswith("13"), F.col(c) + F.expr("INTERVAL 20 YEARS")).otherwise(F.col(c))

    return logs.withColumns({c: moved(c) for c in ("startTime", "endTime")})


def load_auth_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auth_attempts_from_events(_read(spark, sf_dir, "events"))


def replayed_batches(logs: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    """(existing, incoming) for the idempotent load: the table holds the rows
    before ``cut``; a replayed incoming batch overlaps it by two days and
    repeats one day within itself."""
    st = F.col("startTime")
    c = F.lit(cut.isoformat(sep=" ")).cast("timestamp_ntz")
    existing = logs.where(st < c)
    incoming = (logs.where(st >= c - F.expr("INTERVAL 2 DAYS"))
                .unionByName(logs.where((st >= c - F.expr("INTERVAL 1 DAYS"))
                                        & (st < c + F.expr("INTERVAL 1 DAYS")))))
    return existing, incoming
