"""Benchmark decontamination: short test items inside long documents.

Containment search with size-partitioned bottom-s MinHash signatures:

* a text is a set of five-word shingles (lower-cased letters and digits), each
  with one hash.  An item of fewer words is one shingle of all of them; for the
  lengths that such items have (at most four) documents have shingles as well,
  so that a short item is found inside any text;
* items are partitioned by size (powers of two of their shingle count).  An
  item of ``x`` shingles that is contained to a share ``c`` misses at most
  ``x - ceil(c * x)`` of them, so of its ``s = x - ceil(c * x) + 1`` smallest
  hashes at least one occurs in the document.  These ``s`` hashes are its
  MinHash signature; the search loses no item;
* a partition's cut is the largest signature hash in it.  A document with
  ``n`` shingles is looked up in the partitions whose items can be contained
  at all (``ceil(c * x) <= n``) and its sketch holds its hashes up to the
  largest cut among those;
* a document and an item that share a signature hash are a candidate, which
  exact shingle containment then confirms or drops.

A banded index over fixed-length signatures is not used: an item of 30
shingles in a document of 20,000 has a Jaccard similarity near 0.001, where
banding loses items.

Defined cases: null, empty or wordless texts and items match nothing; an item
of fewer than five words matches every document in which its words stand in a
row; texts of any length are searched whole; other columns than those named are
not read or only carried, so their names cannot clash; empty tables give an
empty result, and the stage then keeps every row; equal rows and equal items each get their pairs once per
``(doc_id, item_id)``, with the largest containment where an id repeats; rows
with a null id are searched too and reported under null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .text import indices, let, once, text_key, whole

SHINGLE_WORDS, CONTAINMENT_PERCENT = 5, 80
NOT_WORD = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(whole(text)), NOT_WORD, -1), lambda w: w != "")


def _shingle_hashes(ws: Column, lengths: list[int]) -> Column:
    """Hash of each shingle of these lengths, repeats included, made from the hashes of its words."""
    def of(h: Column, k: int) -> Column:
        return F.transform(indices(F.size(ws) - (k - 1)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.concat(*[of(h, k) for k in lengths]))


def _shingles(ws: Column, lengths: list[int]) -> Column:
    """The shingles of these lengths, each once."""
    def of(k: int) -> Column:
        return F.transform(indices(F.size(ws) - (k - 1)), lambda i: F.concat_ws(" ", *[F.get(ws, i + j) for j in range(k)]))

    return F.array_distinct(F.concat(*[of(k) for k in lengths]))


def items(benchmark: DataFrame, k: int = SHINGLE_WORDS, percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """One row per distinct item: its shingles and their length, how many are needed, size class and signature."""
    rows = once(benchmark.select("item_id", "text").distinct(), "ws", _words(F.col("text"))).where(F.size("ws") > 0)

    def by_length(of) -> Column:
        """``of`` the words and the length of the item's shingles."""
        n, out = F.size("ws"), of(F.col("ws"), [k])
        for short in range(1, k):
            out = F.when(n == short, of(F.col("ws"), [short])).otherwise(out)
        return out

    rows = rows.select("item_id", F.least(F.size("ws"), F.lit(k)).alias("length"), by_length(_shingles).alias("shingles"),
                       F.array_sort(F.array_distinct(by_length(_shingle_hashes))).alias("hashes"))
    x = F.size("shingles")
    rows = rows.withColumn("needed", ((x * percent + 99) / 100).cast("int"))
    return rows.select("item_id", "length", "shingles", "needed", F.floor(F.log2(x)).cast("int").alias("size_class"),
                       F.slice("hashes", F.lit(1), x - F.col("needed") + 1).alias("signature"))


def lengths_of(found: DataFrame, k: int) -> list[int]:
    """Shingle lengths of the items, ``k`` among them; at most ``k`` rows reach the driver."""
    return sorted({k, *(r["length"] for r in found.select("length").distinct().collect())})


def candidates(docs: DataFrame, found: DataFrame, lengths: list[int]) -> DataFrame:
    """``(key, item_id)`` of documents that share a signature hash with an item."""
    # At most 31 rows reach the driver: one for each power of two of an int.
    cuts = (found.groupBy("size_class")
            .agg(F.min("needed").alias("needed"), F.max(F.array_max("signature")).alias("cut")).collect())
    if not cuts:
        return docs.join(found, F.lit(False)).select("key", "item_id")
    partitions = F.array(*[F.struct(F.lit(r["needed"]).alias("needed"), F.lit(r["cut"]).alias("cut")) for r in cuts])
    worded = once(docs.select("text", "key"), "ws", _words(F.col("text"))).drop("text")
    hashed = once(worded, "h", _shingle_hashes(F.col("ws"), lengths)).drop("ws")
    n = F.size("h")
    cut = F.array_max(F.transform(F.filter(partitions, lambda c: c["needed"] <= n), lambda c: c["cut"]))
    sketch = (hashed.withColumn("cut", cut).where("cut is not null")
              .select("key", n.alias("n"), F.explode(F.expr("filter(h, x -> x <= cut)")).alias("hash")))
    signatures = found.select("item_id", "needed", F.explode("signature").alias("hash"))
    return (sketch.join(signatures, "hash")
            .where("needed <= n").select("key", "item_id").distinct())


def contained(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE_WORDS,
              percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """``(doc_id, key, item_id, item_shingles, shared)`` where an item is contained to the wanted share."""
    found = written(items(benchmark, k, percent), "benchmark-items")
    keyed = docs.select("doc_id", "text", text_key(F.col("doc_id"), F.col("text")).alias("key"))
    lengths = lengths_of(found, k)
    pairs = written(candidates(keyed, found, lengths), "contained-candidates")
    # The same join at every size: the candidates grow with the corpus.
    texts = keyed.join(pairs.select("key").distinct().hint("merge"), "key", "left_semi")
    texts = once(once(texts, "ws", _words(F.col("text"))).drop("text"), "own",
                 _shingles(F.col("ws"), lengths)).drop("ws")
    wanted = found.select(F.col("item_id").alias("wanted"), "shingles", "needed")
    checked = texts.join(pairs, "key").join(wanted, F.col("item_id").eqNullSafe(F.col("wanted")))
    return once(checked, "shared", F.size(F.array_intersect("own", "shingles"))).where("shared >= needed").select(
        "doc_id", "key", "item_id", F.size("shingles").alias("item_shingles"), "shared")


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE_WORDS,
                 percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """``(doc_id, item_id, item_shingles, shared, containment)``, a row for each pair."""
    best = contained(docs, benchmark, k, percent).groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("shared") / F.col("item_shingles")).alias("containment"),
                       F.col("item_shingles"), F.col("shared"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.item_shingles").cast("long").alias("item_shingles"),
                       F.col("best.shared").cast("long").alias("shared"), "best.containment")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item."""
    hit = written(contained(docs, benchmark).select("key").distinct(), "contaminated")
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                        text_key(F.col("doc_id"), F.col("text")).alias("key"))
    return keyed.join(hit.hint("merge"), "key", "left_anti").select(*[F.col("row")[c].alias(c) for c in names])
