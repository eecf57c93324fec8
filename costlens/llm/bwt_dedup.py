"""Removal of long repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte is removed when a ``LENGTH``-byte string that covers it starts anywhere
else too, in any text.  Four steps, all over whole texts:

1. *Windows by minimiser.*  The ``LENGTH``-byte windows of a text are cut into
   runs that share the leftmost smallest hash of their ``GRAM``-byte strings.
   Equal windows have equal smallest strings, so a window can only repeat
   inside the runs of one key; a key with a single run holds no repeat (two
   equal windows of one text differ in where that string lies, hence in run).
2. *Segments.*  The bytes of a run that may hold repeats, at most
   ``2 * LENGTH``; equal segments become one segment with a weight.  If a key
   has one segment only, all its windows repeat and nothing is left to find.
3. *Shard transforms and their merge*, for each bucket of keys.  The segments
   of a bucket are dealt into shards of ``SHARD`` bytes; each gets its own
   suffix order and Burrows-Wheeler transform.  The transforms are merged as
   Holt and McMillan do, by refining an interleave: at first the merged ranks
   know one symbol of context, and following the transform's own successor
   permutation brings in the context of later symbols.  The context doubles
   from round to round (the permutation is composed with itself), and only
   blocks that still have several members are touched.  A boundary that
   appears in a round tells the common prefix there; blocks that still hold
   two or more windows at ``LENGTH`` symbols are the repeated intervals.  The
   shards' orders are merged, never sorted again: a round is a stable merge of
   one ascending run per block and shard.
4. *Removal.*  Repeated windows are united to byte ranges per text.

A key whose segments exceed ``LARGE`` bytes is dealt into chunks and every pair
of chunks gets a bucket, so no group holds more than about ``2 * LARGE`` bytes.

Defined cases: a null or empty text has no bytes; texts shorter than
``LENGTH`` lose nothing; matches never cross texts; repeated rows are copies
of each other like any two equal texts; null ids keep their rows; texts of any
length are cut whole, in overlapping pieces; columns other than ``doc_id`` and
``text`` are not read, so their names cannot clash; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import importable, release, written
from .text import whole

LENGTH, GRAM = 400, 16
#: Small enough that sorts and successors of a bucket stay in a core's cache.
BUCKET, SHARD = 1 << 17, 1 << 16
#: Bytes of one key above which its segments are dealt into chunks of that size.
LARGE = 2 << 20
#: Bytes of text whose windows are cut at once, and bits for a place among them.
PIECE, PLACE_BITS = 1 << 20, 24
#: Symbols that one sort key takes.
PACKED = 7

NONE = ~np.uint64(0)


# -- step 1: runs of windows -------------------------------------------------

def _gram_hashes(a: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each place on."""
    words = np.lib.stride_tricks.sliding_window_view(a, 8)
    x = np.ascontiguousarray(words).view(np.uint64).ravel()
    h = x[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += x[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def window_runs(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """``(text, key, first window, number of windows)`` arrays of some texts, looked at as one."""
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate([[0], ends[:-1]])
    a = np.frombuffer(b"".join(texts), np.uint8)
    n, grams = len(a) - length + 1, length - GRAM + 1
    h = _gram_hashes(a)
    # The place in the low bits makes the leftmost of equal hashes the smallest.
    low = np.uint64((1 << PLACE_BITS) - 1)
    ranked = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    blocks = np.concatenate([ranked, np.full(-len(h) % grams, NONE)]).reshape(-1, grams)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], before[grams - 1:grams - 1 + n])
    # Runs end where the smallest changes, where a text begins, and behind its last window.
    edge = np.concatenate([[True], least[1:] != least[:-1], [True]])
    edge[starts[starts < n]] = True
    behind = ends - length + 1
    edge[behind[(behind >= starts) & (behind <= n)]] = True
    first = np.flatnonzero(edge)
    first, count = first[:-1], np.diff(first)
    text = np.searchsorted(ends, first, side="right")
    inside = first < behind[text]
    first, count, text = first[inside], count[inside], text[inside]
    return text, h[(least[first] & low).astype(np.int64)], first - starts[text], count


def _pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """Groups of about ``PIECE`` bytes of texts; a longer text comes in overlapping pieces."""
    marks, datas, size = [], [], 0
    for did, th, text in zip(*(batch.column(i) for i in range(3)), strict=True):
        data = text.as_buffer().to_pybytes()
        for at in range(0, len(data) - length + 1, PIECE):
            marks.append((did.as_py(), th.as_py(), at))
            datas.append(data[at:at + PIECE + length - 1])
            size += len(datas[-1])
            if size >= PIECE:
                yield marks, datas
                marks, datas, size = [], [], 0
    if datas:
        yield marks, datas


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "hi", "lo", "did", "th", "at", "n"]
        for batch in batches:
            for marks, datas in _pieces(batch, length):
                text, key, first, n = window_runs(datas, length)
                digests = b"".join([xxhash.xxh3_128_digest(datas[t][s:s + k + length - 1])
                                    for t, s, k in zip(text.tolist(), first.tolist(), n.tolist(), strict=True)])
                digests = np.frombuffer(digests, np.int64).reshape(-1, 2)
                did, th, at = np.array(marks, np.int64).T[:, text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key.view(np.int64), digests[:, 0], digests[:, 1], did, th, at + first, n.astype(np.int32))],
                    names)
    return run


# -- step 3: shard transforms and their merge --------------------------------

def _starts(key: np.ndarray) -> np.ndarray:
    """Places in a sorted array where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).astype(np.int32)


def _refine(rank: np.ndarray, other: np.ndarray, active: np.ndarray, kind: str = "quicksort") -> np.ndarray:
    """Split equal ranks among ``active`` by their ``other``; the members of blocks that stay larger than one.

    A rank is the number of elements before its block, so blocks keep their
    room and splitting one touches no other.  ``stable`` merges what is in
    order already (see :func:`merged_blocks`).
    """
    if not len(active):
        return active
    key = rank[active].astype(np.uint64)
    key <<= np.uint64(32)
    key |= other.astype(np.uint64)
    order = np.argsort(key, kind=kind)
    key, active = key[order], active[order]
    start = _starts(key)
    size = np.diff(start, append=np.int32(len(key)))
    old = (key[start] >> np.uint64(32)).astype(np.int32)
    first = _starts(old)  # of each old block, among the new ones
    new = old + start - np.repeat(start[first], np.diff(first, append=np.int32(len(old))))
    rank[active] = np.repeat(new, size)
    return active[np.repeat(size > 1, size)]


def _blocks(key: np.ndarray, kind: str = "quicksort") -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the keys and the members of blocks larger than one."""
    order = np.argsort(key, kind=kind).astype(np.int32)
    start = _starts(key[order])
    size = np.diff(start, append=np.int32(len(key)))
    rank = np.empty(len(key), np.int32)
    rank[order] = np.repeat(start, size)
    return rank, order[np.repeat(size > 1, size)]


class Shard:
    """Suffix order and transform of some segments, each ended by a mark of its own.

    Symbols are bytes plus one; 0 is an end mark.  End marks are smaller than
    all bytes and differ from each other by segment.
    """

    def __init__(self, segments: list[bytes]):
        ends = np.cumsum([len(s) + 1 for s in segments]) - 1
        text = np.frombuffer(b"\0".join(segments) + b"\0" * (PACKED + 1), np.uint8)
        n = int(ends[-1]) + 1
        symbols = text[:n].astype(np.uint16) + np.uint16(1)
        symbols[ends] = 0
        left = np.repeat(ends, np.diff(ends, prepend=-1)).astype(np.int32) - np.arange(n, dtype=np.int32)
        # Seven bytes, then how many of them come before the end mark.
        key = np.lib.stride_tricks.sliding_window_view(text, 8)[:n].copy().view(">u8").ravel().astype(np.uint64)
        short = np.minimum(left, PACKED).astype(np.uint64)
        keep = np.array([0, *(((1 << 8 * i) - 1) << 8 * (8 - i) for i in range(1, PACKED + 1))], np.uint64)
        key &= keep[short]
        key |= short
        rank, active = _blocks(key)
        # What reaches its end mark is told apart by the mark, and so by place.
        near = active[left[active] < PACKED]
        _refine(rank, near, near)
        active, h = active[left[active] >= PACKED], PACKED
        while len(active):
            active = _refine(rank, rank[active + h], active)
            h *= 2
        self.order = np.empty(n, np.int32)
        self.order[rank] = np.arange(n, dtype=np.int32)
        self.transform = symbols[self.order - 1]  # the symbol before each suffix, round the end
        self.mark_of = np.cumsum(symbols == 0, dtype=np.int32) - (symbols == 0)  # segment of each place
        self.marks = self.mark_of[self.order - 1]

    def successors(self) -> np.ndarray:
        """For each rank the rank of the suffix one symbol shorter, from the transform alone."""
        # A stable sort of the symbols; end marks go by their segment.
        by = np.argsort(self.transform, kind="stable").astype(np.int32)
        ends = by[:np.count_nonzero(self.transform == 0)]
        ends[:] = ends[np.argsort(self.marks[ends])]
        return by


def merged_blocks(shards: list[Shard], length: int = LENGTH) -> np.ndarray:
    """Block of each merged rank (shard after shard): equal where ``length`` symbols are equal.

    The interleave starts from the shards' own orders and is refined round by
    round.  A shard's ranks are in order of their context, however long, so in
    every round a block is one ascending run per shard, and a stable merge of
    these runs is all there is to do.  ``length`` is at least ``PACKED``.
    """
    offset = np.cumsum([0, *(len(s.order) for s in shards)]).astype(np.int32)
    step = np.concatenate([s.successors() + o for s, o in zip(shards, offset, strict=False)])
    one = np.concatenate([np.sort(s.transform) for s in shards])  # first symbols, in rank order
    # Seven symbols of context for each rank: 4 + 2 + 1, by composing successors.
    two = one.astype(np.uint32) << np.uint32(9) | one[step]
    step2 = step[step]
    key = two.astype(np.uint64) << np.uint64(18) | two[step2]
    step4 = step2[step2]
    key <<= np.uint64(18)
    key |= two[step4]
    step6 = step2[step4]
    key <<= np.uint64(9)
    key |= one[step6]
    jump, h = step[step6], PACKED
    rank, active = _blocks(key, "stable")
    powers = {1: step, h: jump}  # successors after so many symbols
    while len(active) and 2 * h <= length:
        active = _refine(rank, rank[jump[active]], active, "stable")
        h *= 2
        if 2 * h <= length:
            jump = powers[h] = jump[jump]
    if len(active) and h < length:
        reach, at = length - h, active
        for size in sorted(powers, reverse=True):
            while reach >= size:
                at, reach = powers[size][at], reach - size
        _refine(rank, rank[at], active, "stable")
    return rank


def repeated_windows(segments: list[bytes], weights: list[int], length: int = LENGTH,
                     shard: int = SHARD) -> list[np.ndarray]:
    """For each distinct segment, which of its windows occur twice or more among all."""
    shards, held, room = [], [], 0
    parts: list[list[int]] = []
    for i, s in enumerate(segments):
        if not held or room + len(s) > shard:
            held, room = [], 0
            parts.append(held)
        held.append(i)
        room += len(s)
    shards = [Shard([segments[i] for i in part]) for part in parts]
    rank = merged_blocks(shards, length)
    sizes = np.array([len(s) for s in segments])
    repeated = [np.full(max(0, size - length + 1), weight > 1) for size, weight in zip(sizes, weights, strict=True)]
    valid, segment, place, begin = [], [], [], 0
    for part, s in zip(parts, shards, strict=True):
        own = np.array(part)[s.mark_of]
        starts = np.concatenate([[0], np.cumsum(sizes[part] + 1)[:-1]])[s.mark_of]
        inside = np.arange(len(own)) - starts
        own, inside = own[s.order], inside[s.order]
        ok = inside + length <= sizes[own]
        valid.append(rank[begin:begin + len(own)][ok])
        segment.append(own[ok])
        place.append(inside[ok])
        begin += len(own)
    valid, segment, place = (np.concatenate(x) for x in (valid, segment, place))
    often = np.bincount(valid, minlength=1)[valid] > 1
    by = np.argsort(segment[often], kind="stable")
    segment, place = segment[often][by], place[often][by]
    for i, places in zip(*_grouped(segment, place), strict=True):
        repeated[i][places] = True
    return repeated


def _grouped(group: np.ndarray, value: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    return group[first].tolist(), np.split(value, first[1:]) if len(group) else []


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges of the true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _bucket(length: int):
    def run(table: pa.Table) -> pa.Table:
        hi, lo = (table.column(c).to_numpy() for c in ("hi", "lo"))
        _, keep = np.unique(np.stack([hi, lo], 1), axis=0, return_index=True)
        data, weight = table.column("data").take(pa.array(keep)).to_pylist(), table.column("weight").to_numpy()[keep]
        out: list[tuple[int, int, int, int]] = []
        # A bucket of a large key has larger shards, not more of them.
        shard = max(SHARD, sum(map(len, data)) // 8)
        for k, flags in zip(keep.tolist(), repeated_windows(data, weight.tolist(), length, shard), strict=True):
            out += [(int(hi[k]), int(lo[k]), s, e) for s, e in ranges(flags)]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)],
                        names=["hi", "lo", "s", "e"])
    return run


# -- steps 2 and 4 -----------------------------------------------------------

def _cut(length: int):
    """Segments of a text: rows ``(hi, lo, key, weight, data)`` from places in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes()
                for w in wanted.as_py():
                    for out, value in zip(columns, (w["hi"], w["lo"], w["key"], w["weight"],
                                                    data[w["at"]:w["at"] + w["n"] + length - 1]), strict=True):
                        out.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             ["hi", "lo", "key", "weight", "data"])
    return run


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                cut = united([(x["s"], x["e"] + length - 1) for x in spans.as_py() or ()])
                kept, at = hashlib.sha256(), 0
                for s, e in cut:
                    kept.update(data[at:s])
                    at = e
                kept.update(data[at:])
                rows.append((len(data), sum(e - s for s, e in cut), len(cut), kept.hexdigest(), [{"s": s, "e": e} for s, e in cut]))
            spans = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), spans]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])
    return run


def repeats(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET, large: int = LARGE) -> DataFrame:
    """``(did, th, s, e)``: first and last-but-one starts of repeated windows, by hashes of a row's id and text."""
    importable(docs.sparkSession)
    spark = docs.sparkSession
    runs = docs.select("did", "th", "data").where(F.octet_length("data") >= length).mapInArrow(
        _runs(length), "key bigint, hi bigint, lo bigint, did bigint, th bigint, at bigint, n int")
    runs = written(runs, "window-runs")
    # Written, so that the join deals both sides itself and can split a frequent key.
    shared = written(runs.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared-keys")
    places = written(runs.join(shared, "key", "left_semi"), "shared-runs")
    release(spark)
    # One row per distinct segment, read from one of its places.
    segments = written(places.groupBy("hi", "lo", "key", "n").agg(
        F.count("*").alias("weight"), F.min(F.struct("did", "th", "at")).alias("rep")), "distinct-segments")
    # All windows of a key's only segment are there as often as the segment: twice or more.
    several = written(segments.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "merged-keys")
    alone = (segments.join(several, "key", "left_anti")
             .select("hi", "lo", F.lit(0).alias("s"), F.col("n").alias("e")))
    wanted = (segments.join(several, "key", "left_semi").groupBy(F.col("rep.did").alias("did"), F.col("rep.th").alias("th"))
              .agg(F.collect_list(F.struct("hi", "lo", "key", "weight", F.col("rep.at").alias("at"), "n")).alias("wanted")))
    cut = (docs.select("did", "th", "data").join(wanted, ["did", "th"]).select("data", "wanted")
           .mapInArrow(_cut(length), "hi bigint, lo bigint, key bigint, weight bigint, data binary"))
    cut = written(cut, "segments")
    release(spark)
    sized = written(cut.groupBy("key").agg(F.sum(F.octet_length("data")).alias("size")), "key-sizes")
    total = sized.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket))
    split = written(sized.where(F.col("size") > large).select("key", F.ceil(F.col("size") / large).cast("int").alias("k")), "large-keys")
    dealt = (cut.join(split, "key", "left")
             .withColumn("own", F.when(F.col("k") > 1, F.pmod(F.xxhash64("hi", "lo"), F.col("k"))).otherwise(0).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("k"), F.lit(1)) - 1)))
             .select(F.when(F.col("k").isNull(), F.pmod(F.xxhash64("key"), F.lit(buckets))).otherwise(F.col("key")).alias("bucket"),
                     F.col("k").isNotNull().alias("large"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     "hi", "lo", "weight", "data"))
    found = written(dealt.groupBy("bucket", "large", "i", "j").applyInArrow(_bucket(length), "hi bigint, lo bigint, s int, e int"),
                    "repeated-windows")
    release(spark)
    return places.join(found.unionByName(alone), ["hi", "lo"]).select(
        "did", "th", (F.col("at") + F.col("s")).alias("s"), (F.col("at") + F.col("e")).alias("e"))


def without_repeats(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET, large: int = LARGE) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed)`` of every document row."""
    importable(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("doc_id").alias("did"), F.xxhash64(whole(F.col("text"))).alias("th"),
                        whole(F.col("text")).cast("binary").alias("data"))
    spans = (repeats(keyed, length, bucket, large).distinct().groupBy("did", "th")
             .agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    spans = written(spans, "removed-spans")
    release(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.join(spans, ["did", "th"], "left").select("doc_id", "data", "spans").mapInArrow(
        _removed(length), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
                          "removed array<struct<s:bigint,e:bigint>>")
