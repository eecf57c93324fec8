"""SimHash near-duplicates through vantage-point shards.

A fingerprint has 64 majority bits over the XXH64 hashes of a text's word
shingles.  Two fingerprints at ``max_bits`` or fewer differing bits agree, in
one of their 32-bit halves, to within ``r = max_bits // 2`` bits; so each half
gets its own vantage-point tree over the Hamming metric of that half:

* level ``l`` has one vantage point ``v`` (a fingerprint of the data) and the
  median radius ``mu`` of all fingerprints around it, as in multi-vantage-point
  trees, where the nodes of a level share their vantage point.  A fingerprint
  lies inside (``d(x, v) < mu``) or outside; the bits of all levels name its
  shard;
* triangle bound: a neighbour within ``r`` of ``x`` can only lie on the other
  side when ``mu - r <= d(x, v) < mu`` (seen from inside).  All other branches
  are pruned; a fingerprint inside that boundary shell is also placed in the
  shard across it.  Hence two neighbours always meet in the shard that is
  outside wherever one of them is;
* inside a shard all pairs are compared by their full Hamming distance, and a
  spanning forest of the links is emitted, never all pairs.

The depth grows with the number of distinct fingerprints, so shards stay near
``SHARD`` fingerprints.  A shard that holds far more (many different texts
within a few bits) is dealt into chunks and compared chunk pair by chunk pair.
Equal fingerprints are one node, so copies never meet in a shard.

Defined cases: a null, empty or blank text has fingerprint zero and is linked
like any other; a null ``doc_id`` keeps its row and never names a component;
a component whose ids are all null has a null id; repeated rows share their
fingerprint and component; texts of any length are hashed whole; columns other
than those named are only carried, so their names cannot clash; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import importable, written
from .text import let, lower_ascii, shingles, text_key, whole, words

SHINGLE_WORDS, MAX_BITS = 3, 3
#: Wanted fingerprints in a shard, and the most that one task compares at once.
SHARD, CHUNK = 1_000, 16_000
MAX_DEPTH = 28
#: Fingerprints from which vantage points are chosen.
VANTAGE_SAMPLE = 512
#: Hashes whose bits are counted at once.
STEP = 1 << 15


def _majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = batch.column(batch.num_columns - 1)
        ends, flat = hashes.offsets.to_numpy(), hashes.values.to_numpy(zero_copy_only=False)
        prints = np.zeros(len(hashes), np.int64)
        for i in range(len(hashes)):
            h = flat[ends[i]:ends[i + 1]]
            if len(h):
                ones = np.zeros(64, np.int64)
                for at in range(0, len(h), STEP):
                    part = np.ascontiguousarray(h[at:at + STEP]).view(np.uint8).reshape(-1, 8)
                    ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                prints[i] = np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, key, fp)`` of every document row; ``key`` identifies id and text."""
    importable(docs.sparkSession)
    hashes = let(words(lower_ascii(F.col("text"))), lambda ws: F.transform(
        shingles(ws, shingle_words), lambda s: F.xxhash64(s)))
    rows = docs.select("doc_id", text_key(F.col("doc_id"), F.col("text")).alias("key"), hashes.alias("h"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_majority, f"doc_id {doc_type}, key string, fp bigint")


def _half(fp: Column, half: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if half else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _vantage_points(sample: list[int], half: int, depth: int) -> list[int]:
    """Points of the sample at distances near half the bits from each other."""
    pool = np.unique(np.array([(x >> 32 if half else x) & 0xFFFFFFFF for x in sample], np.uint64))
    chosen: list[int] = []
    worst = np.zeros(len(pool))
    for _ in range(min(depth, len(pool))):
        best = int(np.argmin(worst))
        chosen.append(int(pool[best]))
        off = np.abs(np.bitwise_count(pool ^ pool[best]).astype(float) - 16)
        worst = np.maximum(worst, off)
        worst[best] = np.inf
    return chosen


def _tree(prints: DataFrame, depth: int) -> list[list[tuple[int, int]]]:
    """Vantage points and median radii of both halves; the radii regard every fingerprint."""
    if not depth:
        return [[], []]
    # A bounded, hash-ordered sample supplies the vantage points only.
    sample = [r["fp"] for r in prints.orderBy(F.xxhash64("fp"), "fp").limit(VANTAGE_SAMPLE).collect()]
    points = [_vantage_points(sample, half, depth) for half in (0, 1)]
    medians = prints.agg(*[
        F.percentile_approx(F.bit_count(_half(F.col("fp"), half).bitwiseXOR(F.lit(v))), 0.5, 1000).alias(f"m{half}_{i}")
        for half in (0, 1) for i, v in enumerate(points[half])]).first()
    return [[(v, int(medians[f"m{half}_{i}"])) for i, v in enumerate(points[half])] for half in (0, 1)]


def _shards(fp: Column, half: int, levels: list[tuple[int, int]], r: int) -> Column:
    """Ids of the shards that hold a fingerprint: its own and those across a boundary shell."""
    start = F.array(F.lit(half).cast("long"))
    if not levels:
        return start
    steps = F.array(*[F.struct(F.lit(v).cast("long").alias("v"), F.lit(mu).alias("mu"), F.lit(2 << i).cast("long").alias("bit"))
                      for i, (v, mu) in enumerate(levels)])

    def descend(held: Column, level: Column) -> Column:
        far = let(F.bit_count(_half(fp, half).bitwiseXOR(level["v"])), lambda d: F.struct(
            (d < level["mu"]).alias("inside"), (d >= level["mu"] - r).alias("outer")))
        return let(far, lambda f: F.concat(
            F.when(f["inside"], held).otherwise(F.array().cast("array<bigint>")),
            F.when(f["outer"], F.transform(held, lambda c: c + level["bit"])).otherwise(F.array().cast("array<bigint>"))))

    return F.aggregate(steps, start, descend)


def _forest(max_bits: int):
    """Spanning forest of the links inside one shard (or pair of chunks)."""
    def run(table: pa.Table) -> pa.Table:
        rest = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        nodes, roots = [], []
        while rest.size > 1:
            root, rest = rest[0], rest[1:]
            front = [root]
            while front and rest.size:
                near = np.bitwise_count(rest ^ front.pop()) <= max_bits
                if near.any():
                    found, rest = rest[near], rest[~near]
                    front.extend(found)
                    nodes.append(found)
                    roots.append(np.full(found.size, root, np.uint64))
        ends = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (nodes, roots)]
        return pa.table({"a": ends[0].view(np.int64), "b": ends[1].view(np.int64)})
    return run


def links(prints: DataFrame, max_bits: int = MAX_BITS, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints at ``max_bits`` or fewer differing bits.

    ``prints`` has distinct ``fp``.  The result is a forest per shard: it has
    the same components as all pairs, with at most one row per placed fingerprint.
    """
    importable(prints.sparkSession)
    n = prints.count()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n) / shard)))))
    tree = _tree(prints, depth)
    r = max_bits // 2
    placed = prints.select("fp", F.explode(F.concat(
        *[_shards(F.col("fp"), half, tree[half], r) for half in (0, 1)])).alias("shard"))
    large = written(placed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
                    .select("shard", F.ceil(F.col("n") / chunk).cast("int").alias("k")), "large-shards")
    dealt = (placed.join(large, "shard", "left").withColumn("k", F.coalesce("k", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
             .select("shard", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")))
    return (dealt.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
            .groupBy("shard", "i", "j").applyInArrow(_forest(max_bits), "a bigint, b bigint"))


def grouped(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, key, fp, root, component_id)`` of every document row."""
    rows = written(fingerprints(docs, shingle_words), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    joined = components(links(prints.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    nodes = prints.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    nodes = written(nodes, "nodes")
    # Written, so that the join can split a component with very many fingerprints.
    ids = written(nodes.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    return rows.join(nodes.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every document row."""
    return grouped(docs, shingle_words, max_bits).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: the smallest ``doc_id`` (null last), of equal ids the smallest text key."""
    keepers = (grouped(docs, shingle_words, max_bits).groupBy("root")
               .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"))
               .select(F.col("least.key").alias("kept_key")))
    keepers = written(keepers.distinct(), "keepers")
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                        text_key(F.col("doc_id"), whole(F.col("text"))).alias("kept_key"))
    return (keyed.join(keepers.hint("merge"), "kept_key", "left_semi").dropDuplicates(["kept_key"])
            .select(*[F.col("row")[c].alias(c) for c in names]))
