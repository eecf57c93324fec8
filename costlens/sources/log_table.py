"""S3 + S5: the request log as a table of sorted runs with an index of its files.

A load writes one run: a folder with the new rows by day, sorted by (api_key,
startTime) (``layout.py``), and index rows for its files.  A version file
(``costlens.files``) lists the runs of each day, so a load or a compaction is
in the table whole or not at all.

* **Idempotent load.**  The index has each file's smallest and greatest request
  id and a Bloom filter of its ids (``HASHES`` bits of ``BITS`` an id, in pages of
  Spark's bitmap functions; only pages with a bit set are stored).  A batch is
  joined to the files by ranges cut from its own ids, then each pair is probed in
  the filter.  Only files that may hold one of the batch's ids are opened, and of
  these one column is read.  Ids that follow time touch few files.  For random
  ids every file's range spans every id; ``within`` then limits the search to
  files of days near the row's own, if copies are known to lie that close.
* **Compaction.**  Every load adds a run to the days it touches, each of which
  spans all keys.  The files' key ranges show the days in which runs overlap;
  these runs are merged into one, other days and runs stay as they are.

Copies of one batch: the earliest counts (``load.first_copies``).  Rows without
an id are not kept, as the primary key forbids them.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costlens import files as V
from costlens.sources.layout import LAYOUT_SCHEMA, write_log_layout
from costlens.sources.load import first_copies

HASHES, BITS = 4, 1 << 24
#: Ids that the ranges of a load are cut from, and the number of ranges.
SAMPLE, RANGES = 4_000, 256
FILE_SCHEMA = "file string, day date, rows bigint, key_lo string, key_hi string, id_lo string, id_hi string, v string"
PAGE_SCHEMA = "file string, page bigint, bits binary, v string"

#: Which runs (folders) hold rows of each day.
Runs = dict[str, list[str]]


def _places(request_id: Column) -> Column:
    """The filter's bits for an id, numbered from 1."""
    return F.transform(F.array(*map(F.lit, range(HASHES))), lambda j: F.pmod(F.xxhash64(request_id, j), F.lit(BITS)) + 1)


def _set(bits: Column, bit: Column) -> Column:
    """Whether a bit of a page is set."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.get(F.transform(F.array(byte), lambda b: F.floor(b / F.pow(F.lit(2.0), bit % 8)) % 2), F.lit(0)) == 1


@dataclass(frozen=True)
class LogTable:
    path: str
    row_group_bytes: int | None = None
    partitions: int | None = None

    def runs(self, spark: SparkSession) -> Runs:
        return V.latest(V.Files(spark, self.path)).get("runs", {})

    def _read(self, spark: SparkSession, runs: Runs, columns: tuple[str, ...] = ()) -> DataFrame:
        folders = [f"{self.path}/v={v}/day={day}" for day, of in sorted(runs.items()) for v in of]
        columns = columns or tuple(LAYOUT_SCHEMA.names)
        if not folders:
            return spark.createDataFrame([], LAYOUT_SCHEMA).select(*columns)
        return spark.read.schema(LAYOUT_SCHEMA).option("basePath", self.path).parquet(*folders).select(*columns)

    def read(self, spark: SparkSession) -> DataFrame:
        """The log; ``day`` is a partition column that reports filter on."""
        return self._read(spark, self.runs(spark))

    # ------------------------------------------------------------------ index
    def _index(self, spark: SparkSession, name: str, schema: str, runs: Runs) -> DataFrame:
        live = sorted({v for of in runs.values() for v in of})
        if not live:
            return spark.createDataFrame([], schema)
        rows = (spark.read.schema(schema).option("basePath", f"{self.path}/_{name}")
                .parquet(*[f"{self.path}/_{name}/v={v}" for v in live]))
        here = spark.createDataFrame([(day, v) for day, of in runs.items() for v in of], "at string, v string")
        return rows.withColumn("at", F.regexp_extract("file", "day=([^/]+)/", 1)).join(here, ["at", "v"], "left_semi").drop("at")

    def _write_run(self, spark: SparkSession, rows: DataFrame, version: int) -> Runs:
        """Write rows as one run with its index; the days it has rows of."""
        run = V.folder_of(version)
        at = f"{self.path}/v={run}"
        write_log_layout(rows, at, self.partitions, "errorifexists", self.row_group_bytes)
        days = [n.removeprefix("day=") for n in V.Files(spark, at).names("") if n.startswith("day=")]
        if not days:
            return {}
        file = F.concat(F.lit(f"v={run}/"), F.regexp_extract("_metadata.file_path", "(day=[^/]+/[^/]+)$", 1)).alias("file")
        ids = spark.read.schema(LAYOUT_SCHEMA).option("basePath", at).parquet(at).select(file, "day", "api_key", "request_id")
        (ids.groupBy("file", "day").agg(F.count(F.lit(1)).alias("rows"), F.min("api_key").alias("key_lo"), F.max("api_key").alias("key_hi"),
                                        F.min("request_id").alias("id_lo"), F.max("request_id").alias("id_hi"))
         .write.parquet(f"{self.path}/_files/v={run}"))
        bits = ids.select("file", F.explode(_places(F.col("request_id"))).alias("place"))
        (bits.groupBy("file", F.bitmap_bucket_number("place").alias("page"))
         .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
         .write.parquet(f"{self.path}/_pages/v={run}"))
        return {day: [run] for day in days}

    def candidates(self, spark: SparkSession, runs: Runs, ids: DataFrame, within: timedelta | None = None) -> list[str]:
        """The files that may hold one of ``ids (request_id, day)``, as paths."""
        files = self._index(spark, "files", FILE_SCHEMA, runs)
        some = [r[0] for r in ids.select("request_id").orderBy(F.xxhash64("request_id"), "request_id").limit(SAMPLE).collect()]
        some.sort(key=lambda x: x.encode())
        bounds = F.array(*[F.lit(some[i * len(some) // RANGES]) for i in range(1, RANGES)]) if some else F.array().cast("array<string>")

        def span(value: Column) -> Column:
            return F.size(F.filter(bounds, lambda b: b <= value))

        spans = files.select("file", F.col("day").alias("file_day"), "id_lo", "id_hi", F.explode(F.sequence(span(F.col("id_lo")), span(F.col("id_hi")))).alias("span"))
        near = F.col("request_id").between(F.col("id_lo"), F.col("id_hi"))
        if within is not None:
            near = near & (F.abs(F.datediff("file_day", "day")) <= within.days)
        pairs = ids.withColumn("span", span(F.col("request_id"))).join(spans, "span").where(near).select("file", "request_id")
        probes = pairs.select("file", "request_id", F.explode(_places(F.col("request_id"))).alias("place"))
        probes = probes.select("file", "request_id", F.bitmap_bucket_number("place").alias("page"), F.bitmap_bit_position("place").alias("bit"))
        hit = (probes.join(self._index(spark, "pages", PAGE_SCHEMA, runs).select("file", "page", "bits"), ["file", "page"])
               .where(_set(F.col("bits"), F.col("bit"))).groupBy("file", "request_id").count().where(F.col("count") == HASHES))
        return [f"{self.path}/{r['file']}" for r in hit.select("file").distinct().collect()]

    # ------------------------------------------------------------------ loads
    def append(self, spark: SparkSession, incoming: DataFrame, within: timedelta | None = None) -> None:
        """Add the rows whose id is not stored; a repeated load adds nothing."""
        batch = first_copies(incoming.where(F.col("request_id").isNotNull())).withColumn("day", F.to_date("startTime")).persist()

        def build(version: int, runs: Runs) -> Runs | None:
            opened = self.candidates(spark, runs, batch.select("request_id", "day"), within)
            new = batch
            if opened:
                known = spark.read.schema(LAYOUT_SCHEMA).parquet(*opened).select("request_id")
                new = batch.join(known.join(batch.select("request_id"), "request_id", "left_semi").distinct(), "request_id", "left_anti")
            made = self._write_run(spark, new.select(*LAYOUT_SCHEMA.names[:-1]), version)
            return {day: [*runs.get(day, []), *made.get(day, [])] for day in {*runs, *made}} if made else None

        try:
            self._commit(spark, build)
        finally:
            batch.unpersist()

    def overlapping(self, spark: SparkSession, most: int = 1) -> Runs:
        """Runs that share key ranges, of the days in which more than ``most`` do so."""
        files = self._index(spark, "files", FILE_SCHEMA, self.runs(spark))
        before = Window.partitionBy("day").orderBy("key_lo", "key_hi", "file")
        reach = F.max("key_hi").over(before.rowsBetween(Window.unboundedPreceding, -1))
        cluster = F.sum(F.when(F.col("key_lo") < reach, 0).otherwise(1)).over(before.rowsBetween(Window.unboundedPreceding, 0))
        crowded = (files.withColumn("cluster", cluster).groupBy("day", "cluster").agg(F.collect_set("v").alias("runs"))
                   .where(F.size("runs") > most).groupBy("day").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs")))
        return {str(r["day"]): list(r["runs"]) for r in crowded.collect()}

    def compact(self, spark: SparkSession, most: int = 1) -> list[str]:
        """Merge overlapping runs day by day; returns the days rewritten."""
        done: list[str] = []

        def build(version: int, runs: Runs) -> Runs | None:
            todo = {d: of for d, of in self.overlapping(spark, most).items() if set(of) <= set(runs.get(d, []))}
            done[:] = sorted(todo)
            if not todo:
                return None
            made = self._write_run(spark, self._read(spark, todo, tuple(LAYOUT_SCHEMA.names[:-1])), version)
            return {d: [*[v for v in of if v not in todo.get(d, [])], *made.get(d, [])] for d, of in runs.items()}

        self._commit(spark, build)
        return done

    def _commit(self, spark: SparkSession, build) -> None:
        files = V.Files(spark, self.path)
        for _ in range(V.ATTEMPTS):
            base = V.latest(files)
            version = base.get("version", 0) + 1
            runs = build(version, base.get("runs", {}))
            if runs is None or V.commit(files, version, {"version": version, "runs": runs}):
                return
        raise RuntimeError(f"other writers were faster {V.ATTEMPTS} times: {self.path}")

    def vacuum(self, spark: SparkSession, keep: int = 20) -> int:
        """Remove runs that the newest ``keep`` versions do not list."""
        return V.vacuum(V.Files(spark, self.path), keep, ("", "_files", "_pages"),
                        lambda state: {v for of in state["runs"].values() for v in of})
