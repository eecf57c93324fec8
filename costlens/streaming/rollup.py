"""T1 + T4: streaming daily rollup with at-most-once counting per request_id.

readStream (Parquet landing folder, declared schema) -> rows dated ahead of
their arrival to quarantine (``admission.py``) -> copies of one request id
collapsed inside each task -> event time as a ``timestamp`` instant (watermarks
reject timestamp_ntz) -> watermark -> ``dropDuplicatesWithinWatermark(request_id)``
-> tumbling 1-day window x api_key x raw model -> update mode: every micro-batch
gives the new totals of the groups it changed, days still open included ->
``foreachBatch`` swaps in the next version of rollup and alerts with these
groups replaced (``store.publish_groups``); a batch that is published already is
skipped.  Today's figures and a budget crossing therefore show after the next
batch.  The key table is read anew in every batch.

State (ids of one lateness span, totals of the open days) is kept in RocksDB,
set on a session of the stream's own.  Rows dropped as too late are handled by
the reconcile job (``reconcile.py``).  ``run_once`` processes what has landed
and stops (tests, scheduled jobs); ``start`` keeps the queries running with a
processing-time trigger.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from costlens.config import DEFAULT_CONFIG, ReportConfig
from costlens.files import Files
from costlens.functions.time import event_instant, instant_utc_day
from costlens.operators.facts import sum_measures
from costlens.schemas import SPEND_LOGS_SCHEMA
from costlens.streaming import admission
from costlens.streaming.store import Keys, Store, publish_groups

#: State partitions of a new stream at least, and the landed bytes that one more of them is for.
STATE_PARTITIONS, STATE_BYTES = 16, 8 << 20
#: Repeated request ids that a task remembers at a time.
REMEMBERED = 50_000


def stream_measures(logs: DataFrame, cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    return logs.select(
        "request_id", "api_key", "model",
        event_instant(F.col("startTime")).alias("event_time"),
        F.col("spend").cast(cfg.money_type).alias("spend"),
        F.when(F.col("request_id").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
         .alias("requests"),
        F.col("total_tokens").cast("bigint").alias("tokens"),
        F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"),
        F.col("completion_tokens").cast("bigint").alias("completion_tokens"),
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def collapsed(rows: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """T4, first level: of the copies of a request id in a task the latest, before any shuffle.

    A streaming aggregate has no map-side step for de-duplication: all copies
    of an id would go to the one state task of its hash.  Here a storm of copies
    stays in the tasks that read it, and each of these sends on about one row.
    An Arrow batch keeps an id's latest row; ids that were repeated are
    remembered, and later copies pass only if they are dated later still.  (The
    latest copy is the one that is not behind the watermark if any is not.)
    ``remembered`` bounds the memory; what is forgotten the keyed state drops.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, int] = {}
        for batch in batches:
            ids = batch.column(0).dictionary_encode(null_encoding="encode")
            code = ids.indices.to_numpy(zero_copy_only=False)
            time = batch.column(3).cast(pa.int64()).to_numpy(zero_copy_only=False)
            order = np.lexsort((-np.arange(len(code)), time, code))
            last = np.flatnonzero(np.append(code[order][1:] != code[order][:-1], len(code) > 0))
            kept, copies = order[last], np.diff(np.append(-1, last))
            old = pc.is_in(ids.dictionary, value_set=pa.array(list(known), ids.dictionary.type)).to_numpy(zero_copy_only=False)
            seen = (old[code[kept]] | (copies > 1)) if len(kept) else np.zeros(0, bool)
            drop = np.zeros(len(kept), bool)
            for i in np.flatnonzero(seen):
                name = ids.dictionary[int(code[kept[i]])].as_py()
                drop[i] = known.get(name, -(1 << 63)) >= time[kept[i]]
                known[name] = max(known.get(name, -(1 << 63)), int(time[kept[i]]))
            if len(known) > remembered:
                known = {}
            yield batch.take(pa.array(np.sort(kept[~drop])))

    return rows.mapInArrow(run, rows.schema)


def day_groups(stream: DataFrame, lateness: str, cfg: ReportConfig = DEFAULT_CONFIG) -> DataFrame:
    """The streaming plan: dedupe in tasks, then within the watermark, then daily windows."""
    m = collapsed(stream_measures(stream, cfg))
    deduped = m.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["request_id"])
    agg = deduped.groupBy(F.window("event_time", "1 day").alias("w"), "api_key", "model") \
        .agg(*sum_measures())
    return agg.select(instant_utc_day(F.col("w.start")).alias("day"), "api_key", "model",
                      "spend", "requests", "tokens", "prompt_tokens", "completion_tokens")


def state_size(spark: SparkSession, landing: str, checkpoint: str) -> int | None:
    """State partitions for a query's first start; None later, when the checkpoint has their number.

    Every batch opens, saves and uploads the stores of every partition, however
    few rows they hold, so their number follows the cores and what has landed,
    up to the caller's shuffle partitions.
    """
    if Files(spark, checkpoint).names("offsets"):
        return None
    landed = -(-Files(spark, landing).size("") // STATE_BYTES)
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")),
               max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism, landed))


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """The stream's own session: RocksDB state, the caller's other settings unchanged."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.conf.get("spark.sql.shuffle.partitions")))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Each write would look its key up once more only to count rows.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    return own


@dataclass(frozen=True)
class Input:
    """Where the stream reads, and what it admits."""

    landing: str
    lateness: str = "1 day"
    tolerance: str = admission.TOLERANCE
    clock: datetime | None = None


def _writers(spark: SparkSession, source: Input, store: Store, checkpoint: str, keys: Keys, cfg: ReportConfig,
             state_partitions: int | None):
    """The rollup query and the quarantine query."""
    own = stream_session(spark, state_partitions or state_size(spark, source.landing, checkpoint))

    def landed() -> DataFrame:
        return own.readStream.schema(SPEND_LOGS_SCHEMA).parquet(source.landing)

    def publish(batch: DataFrame, batch_id: int) -> None:
        # The query's id is kept in its checkpoint: restarts go on counting, a new checkpoint is a new stream.
        query = json.loads(Files(spark, checkpoint).text("metadata"))["id"]
        publish_groups(spark, store, batch, keys(spark), cfg, (query, batch_id))

    rows = admission.admitted(landed(), source.tolerance, source.clock)
    return ((day_groups(rows, source.lateness, cfg).writeStream
             .outputMode("update")
             .option("checkpointLocation", checkpoint)
             .foreachBatch(publish)),
            admission.quarantine_writer(landed(), store.root, checkpoint, source.tolerance, source.clock))


def run_once(spark: SparkSession, landing: str, store: Store, checkpoint: str,
             keys: Keys, lateness: str = "1 day",
             cfg: ReportConfig = DEFAULT_CONFIG, state_partitions: int | None = None,
             tolerance: str = admission.TOLERANCE, clock: datetime | None = None) -> dict | None:
    """Process everything landed so far (``availableNow``) and stop.

    Returns the last progress report (it carries the event-time watermark).

    ``state_partitions`` sets how many state-store partitions the stateful
    operators get on the query's first start (later restarts keep the number
    recorded in the checkpoint); by default ``state_size``.
    Size it to the state (request ids of one lateness span plus the open day
    groups), not to the input.  ``tolerance`` and ``clock`` are those of
    ``admission.admitted``.
    """
    source = Input(landing, lateness, tolerance, clock)
    queries = [w.trigger(availableNow=True).start() for w in _writers(spark, source, store, checkpoint, keys, cfg, state_partitions)]
    for q in queries:
        q.awaitTermination()
    return queries[0].lastProgress


@dataclass(frozen=True)
class RollupStream:
    """The two running queries."""

    rollup: StreamingQuery
    quarantine: StreamingQuery

    def processAllAvailable(self) -> None:  # noqa: N802 - as on a StreamingQuery
        self.rollup.processAllAvailable()
        self.quarantine.processAllAvailable()

    def stop(self) -> None:
        self.rollup.stop()
        self.quarantine.stop()


def start(spark: SparkSession, landing: str, store: Store, checkpoint: str, keys: Keys,
          lateness: str = "1 day", every: str = "5 minutes",
          cfg: ReportConfig = DEFAULT_CONFIG, state_partitions: int | None = None,
          tolerance: str = admission.TOLERANCE) -> RollupStream:
    """The long-running form: one micro-batch every ``every`` (the client's
    300 s refresh), same plans and checkpoint layout as ``run_once``."""
    writers = _writers(spark, Input(landing, lateness, tolerance), store, checkpoint, keys, cfg, state_partitions)
    return RollupStream(*[w.trigger(processingTime=every).start() for w in writers])


def watermark_day(progress: dict | None) -> date | None:
    """UTC day of the stream's event-time watermark, from its progress report."""
    if not progress:
        return None
    wm = (progress.get("eventTime") or {}).get("watermark")
    if not wm:
        return None
    ts = datetime.strptime(wm[:19], "%Y-%m-%dT%H:%M:%S")
    return None if ts.year < 1971 else ts.date()
