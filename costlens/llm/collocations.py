"""Phrase collocations from a weighted de Bruijn graph of the corpus.

Texts are cut into pieces at sentence marks and line ends, pieces into words.
Only the longest grams are counted: the ``LONGEST`` words from every word on,
cut off where the piece ends.  Full ones are the graph's edges (node = all but
the last word to node = all but the first), short ones the piece-end
corrections.  The flow of a node, which is the number of occurrences of its
words, is the sum of its outgoing edges plus the pieces that end with it; the
same step gives every shorter phrase, down to single words.

1. Each task counts the grams of about ``HELD`` words at a time and ships one
   row per different gram.
2. The rows are dealt by ranges of the gram's byte order, so that all grams
   with a common beginning are neighbours, and sorted.  The range bounds are
   quantiles of a bounded sample (``SAMPLE`` grams); they decide the balance only.
   A frequent beginning may fill several ranges, so no word or phrase fills a
   task.
3. A sorted block gives the flows of all lengths at once.  Flows that lie inside
   a block are final and kept from ``least`` on; the first and last of a block
   go out as partial sums, whatever their size, and are added up.
4. Unary paths are compacted: a phrase whose whole flow passes through one edge,
   ahead or behind, stands for nothing but that edge and is absorbed by it.  (If
   any longer phrase contains another and is as frequent, so is a phrase longer
   by one word.)  :func:`paths` compacts the chains of longest edges as well.
5. Candidates are scored at their weakest cut, in decimal arithmetic of 38 digits.

Defined cases: a null text has no words, a null language is ``und``; repeated
rows count each; words and texts of any length are taken whole; other columns
than ``lang`` and ``text`` are not read, so their names cannot clash; an empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import importable, written

LONGEST, LEAST, TOP = 5, 100, 2000
#: Words counted at once in a task, rows of a sorted block, rows of an Arrow batch sent on.
HELD, BLOCK, SENT = 1_500_000, 200_000, 20_000
#: Texts and grams that the range bounds come from, tasks that count the sample, and the bytes of a bound.
SAMPLE_TEXTS, SAMPLE, SAMPLE_TASKS, BOUND = 2_000, 10_000, 4, 96
UNKNOWN = "und"
#: A byte that UTF-8 never uses stands for the end of a piece.
END = b"\xff"
MARKS = b".,;:!?\n\x0b\x0c\r"
TO_LOWER = bytes.maketrans(MARKS + bytes(range(65, 91)), END * len(MARKS) + bytes(range(97, 123)))


def words(texts: list[bytes]) -> list[bytes]:
    """The words of the texts in order, ``END`` after every piece."""
    return (END.join(texts) + END).translate(TO_LOWER).replace(END, b" " + END + b" ").split()


def _grams(ids: np.ndarray, longest: int, n_ids: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Different grams in order, as one column of ids per place (0: the piece has ended), and their counts.

    ``ids`` are numbers from 1 on, 0 for the end of a piece.
    """
    padded = np.concatenate([ids, np.zeros(longest, ids.dtype)])
    columns = [ids[ids > 0]]
    alive, at = np.ones(len(columns[0]), bool), np.flatnonzero(ids)
    for j in range(1, longest):
        alive &= padded[at + j] > 0
        columns.append(np.where(alive, padded[at + j], 0))
    bits = max(1, n_ids.bit_length())
    per = max(1, 63 // bits)
    keys = [reduce(lambda key, c: (key << bits) | c, (c.astype(np.int64) for c in columns[i:i + per])) for i in range(0, longest, per)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, [(k := key[order])[1:] != k[:-1] for key in keys])
    starts = np.flatnonzero(new)
    return [c[order[starts]] for c in columns], np.diff(np.append(starts, len(order)))


def _sorted_grams(lang: str, found: list[bytes], longest: int) -> tuple[pa.Array, np.ndarray]:
    """The different grams of the words in byte order, and their counts.

    A gram is written as the language in hexadecimal and the words, a space
    after each, so that no gram's beginning ends inside a word.
    """
    numbers = {w + b" ": n for n, w in enumerate(sorted({*found} - {END}, key=lambda w: w + b" "), 1)}
    get = {k[:-1]: n for k, n in numbers.items()} | {END: 0}
    ids = np.fromiter(map(get.__getitem__, found), np.int32, len(found))
    columns, counts = _grams(ids, longest, len(numbers))
    shown = pa.array([b"", *numbers], pa.binary()).cast(pa.string())
    head = lang.encode().hex() + " "
    return pc.binary_join_element_wise(head, *[shown.take(pa.array(c)) for c in columns], ""), counts


def _counted(longest: int, held: int, bounds: list[bytes]):
    """Rows ``(gram, n, bucket)`` of the texts of a task."""
    def flush(waiting: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, found in waiting.items():
            shown, counts = _sorted_grams(lang, found, longest)
            places = _Strings(shown)
            begins = np.array([bisect_left(places, b) for b in bounds], np.int64)
            bucket = np.searchsorted(begins, np.arange(len(counts)), "right")
            for i in range(0, len(counts), SENT):
                part = slice(i, i + SENT)
                yield pa.RecordBatch.from_arrays([shown.slice(i, SENT), pa.array(counts[part], pa.int64()), pa.array(bucket[part], pa.int32())],
                                                 ["gram", "n", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        n = 0
        for batch in batches:
            langs = pc.fill_null(batch.column(0), UNKNOWN).to_pylist()
            for lang, text in zip(langs, batch.column(1).cast(pa.binary()), strict=True):
                found = words([text.as_py() or b""])
                waiting.setdefault(lang, []).extend(found)
                n += len(found)
                if n >= held:
                    yield from flush(waiting)
                    waiting, n = {}, 0
        yield from flush(waiting)
    return run


class _Strings:
    """An Arrow array of strings as a sequence of its UTF-8 bytes (byte order, as Spark compares)."""

    def __init__(self, values: pa.Array):
        self.values = values

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, i: int) -> bytes:
        return self.values[i].as_py().encode()


def _bounds(texts: DataFrame, longest: int, partitions: int) -> list[bytes]:
    """Range bounds from a bounded sample of grams of a bounded sample of texts."""
    share = SAMPLE_TEXTS / max(1, texts.count())
    sample = texts if share >= 1 else texts.sample(share, seed=7)
    some = (sample.repartition(SAMPLE_TASKS).mapInArrow(_counted(longest, HELD, []), "gram string, n bigint, bucket int")
            .select(F.col("gram").cast("binary").substr(1, BOUND).alias("gram"), F.xxhash64("gram").alias("h")).orderBy("h").limit(SAMPLE))
    grams = sorted(bytes(r["gram"]) for r in some.collect())
    return sorted({grams[i * len(grams) // partitions] for i in range(1, partitions)}) if grams else []


def _flows(longest: int, least: int, block: int):
    """Rows ``(key, n)``: the flows of sorted grams for every number of words; the language alone for none."""
    def of(table: pa.Table) -> pa.RecordBatch:
        gram, n = table["gram"].combine_chunks(), table["n"].to_numpy()
        parts = pc.split_pattern(gram, " ")  # language, words, nothing
        size = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.dictionary_encode(parts.flatten()).indices.to_numpy(zero_copy_only=False)
        at = np.cumsum(size) - size
        ids = np.full((len(n), longest + 1), -1, np.int64)
        for k in range(longest + 1):
            has = size - 1 > k
            ids[has, k] = flat[at[has] + k]
        same = np.logical_and.accumulate(ids[1:] == ids[:-1], axis=1)
        keys: list[str] = []
        flows: list[int] = []
        for k in range(longest + 1):
            begin = np.concatenate([[0], np.flatnonzero(~same[:, k]) + 1])
            total = np.add.reduceat(n, begin)
            part_only = (begin == 0) | (np.append(begin[1:], len(n)) == len(n))
            kept = (ids[begin, k] >= 0) & ((total >= least) | part_only | (k == 0))
            keys += [" ".join(g.split(" ")[:k + 1]) for g in gram.take(pa.array(begin[kept])).to_pylist()]
            flows += total[kept].tolist()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(flows, pa.int64())], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= block:
                yield of(pa.Table.from_batches(waiting))
                waiting = []
        if waiting:
            yield of(pa.Table.from_batches(waiting))
    return run


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, held: int = HELD, block: int = BLOCK,
             partitions: int | None = None) -> DataFrame:
    """``(lang, k, phrase, f)``: every phrase of 1 to ``longest`` words with ``f >= least`` occurrences.

    ``k = 0`` rows hold the number of words of each language.  ``held``,
    ``block`` and ``partitions`` (by default the session's) change the cost only.
    """
    spark = docs.sparkSession
    importable(spark)
    texts = docs.select("lang", "text")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(texts, longest, partitions)
    counted = texts.mapInArrow(_counted(longest, held, bounds), "gram string, n bigint, bucket int")
    dealt = counted.repartitionById(partitions, F.col("bucket")).sortWithinPartitions("gram").select("gram", "n")
    part = F.split("key", " ")
    flows = (dealt.mapInArrow(_flows(longest, least, block), "key string, n bigint").groupBy("key").agg(F.sum("n").alias("f"))
             .select(F.decode(F.unhex(F.get(part, F.lit(0))), "utf-8").alias("lang"), (F.size(part) - 1).alias("k"),
                     F.array_join(F.slice(part, 2, longest), " ").alias("phrase"), "f"))
    return written(flows.where((F.col("f") >= least) | (F.col("k") == 0)), "frequent")


def _span(phrase: Column, start: Column | int, n: Column | int) -> Column:
    """``n`` words of the phrase from the ``start``-th on (from 1)."""
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def absorbed(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, f)`` of the phrases all of whose occurrences lie in one phrase longer by a word."""
    inner = F.explode(F.array(_span(F.col("phrase"), 1, F.col("k") - 1), _span(F.col("phrase"), 2, F.col("k") - 1)))
    return phrases.where("k > 1").select("lang", inner.alias("phrase"), "f").distinct()


def scored(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` of all phrases of two words or more, by their weakest cut."""
    def exact(name: str) -> Column:
        return F.col(name).cast("decimal(19,0)")

    sizes = phrases.where("k = 0").select("lang", F.col("f").alias("n"))
    cuts = phrases.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"),
                                         F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"first": _span(F.col("phrase"), 1, F.col("cut")),
                             "rest": _span(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut"))})
    parts = phrases.where("k > 0")
    cuts = (cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
            .join(sizes, "lang")
            .withColumns({"joint": exact("a") * exact("n") * F.lit(1000), "apart": exact("l") * exact("r")})
            .withColumn("score", F.expr("joint div apart")))
    least = F.min(F.struct("score", "cut", "l", "r"))
    return (cuts.groupBy("lang", "phrase", "a", "n").agg(least.alias("x"))
            .select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score"))


def paths(phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``(lang, phrase, f)``: the longest edges, chains of them along unary nodes compacted to one phrase.

    A node is unary if its whole flow comes in by one edge and leaves by one.
    Positions on a chain come from pointer jumping; a ring without a first edge
    stays as its edges.
    """
    edge, w = F.col("phrase"), longest - 1
    edges = phrases.where(F.col("k") == longest).select("lang", "phrase", "f", _span(edge, 1, w).alias("head"), _span(edge, 2, w).alias("tail"))
    nodes = phrases.where(F.col("k") == w).select("lang", F.col("phrase").alias("node"), "f")
    before = (edges.select("lang", F.col("phrase").alias("to"), F.col("tail").alias("node"), "f").join(nodes, ["lang", "node", "f"])
              .join(edges.select("lang", "phrase", F.col("head").alias("node"), "f"), ["lang", "node", "f"])
              .select("lang", "phrase", "to"))
    steps = written(edges.join(before, ["lang", "phrase"], "left")
                    .select("lang", "phrase", "f", F.coalesce("to", "phrase").alias("to"), F.col("to").isNotNull().cast("long").alias("place")), "paths")
    for _ in range(max(1, steps.count()).bit_length()):
        far = steps.select("lang", F.col("phrase").alias("to"), F.col("to").alias("far"), F.col("place").alias("more"))
        steps = written(steps.join(far, ["lang", "to"]).select("lang", "phrase", "f", F.col("far").alias("to"), (F.col("place") + F.col("more")).alias("place")), "paths")
    first = steps.where("place = 0").select("lang", F.col("phrase").alias("to"), F.lit(True).alias("open"))
    chains = (steps.join(first, ["lang", "to"], "left")
              .select("lang", "f", F.when(F.col("open"), F.col("to")).otherwise(edge).alias("first"), "place", _span(edge, longest, 1).alias("last"),
                      F.col("open").isNotNull().alias("open")))
    chain = F.array_sort(F.collect_list(F.when(F.col("open") & (F.col("place") > 0), F.struct("place", "last"))))
    return (chains.groupBy("lang", "first", "f").agg(chain.alias("chain"))
            .select("lang", F.concat_ws(" ", F.array("first"), F.col("chain.last")).alias("phrase"), "f"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, held: int = HELD,
                 block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of 2 to ``longest`` words.

    ``a`` is the phrase's number of occurrences, ``l`` and ``r`` those of the
    two sides of its weakest cut, ``n`` the language's number of words and
    ``score = floor(1000 a n / (l r))``.
    """
    phrases = frequent(docs, least, longest, held, block, partitions)
    inner = absorbed(phrases).withColumnRenamed("f", "a")
    kept = scored(phrases).join(inner, ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
