"""Hard negatives by exact integer scores from residue-number-system products.

Components are quantised to integers.  An inner product of integers is exact in
float32 as long as no partial sum passes 2^24, so each block of scores is
computed as several small matrix products: components modulo a prime below
1024, centred, ``CHUNK`` dimensions at a time (64 * 510^2 < 2^24).  The signed
score comes back by Chinese remaindering with balanced mixed-radix digits; as
many primes are used as the block's largest possible score needs.

Anchors and rows are dealt into blocks of bounded size, and a task multiplies
one block of anchors with one block of rows.  A first pass keeps, per cell and
anchor, the best rows of the same label, a second one the best rows of other
labels inside each positive's score window; window functions merge the cells'
lists.  Lists of a cell are as long as the wanted lists, so the merge is exact.
Blocks are dealt by a hash of the row, so a frequent label or id fills no block.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component take no part.  Vectors of unequal length count as padded
with zeros.  Repeated rows are rows of their own: a copy of an anchor can be its
positive, and each copy of an anchor gets its own result rows.  Equal scores
are ordered by smaller id.  Columns other than the three named are not read, so
their names cannot clash.  An empty table gives an empty result.  A component
beyond 32 bits or a score that could pass 62 bits raises an error: the result
column could not hold it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import importable, written

#: Primes of the residue number system, all below 1024; dimensions summed before reducing.
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)
CHUNK = 64
#: Rows of a block, anchors of a block, anchors whose scores are held at once.
ROWS, ANCHORS, STRIP = 16_384, 16_384, 256
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's score.
LEAST, MOST = 50, 95
NONE = -(1 << 62)


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """The residue of least absolute value, ``x`` an integer array, ``p`` odd."""
    r = np.remainder(x, p)
    return np.where(r > p // 2, r - p, r)


def moduli(bound: int) -> tuple[int, ...]:
    """As many primes as tell all integers of absolute value up to ``bound`` apart."""
    product = 1
    for n, p in enumerate(PRIMES):
        product *= p
        if product > 2 * bound:
            return PRIMES[:n + 1]
    raise OverflowError("scores may pass 62 bits")


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact, from float32 products modulo small primes."""
    dims = a.shape[1]
    most = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    bound = dims * most[0] * most[1]
    if bound >= 1 << 62:
        raise OverflowError("scores may pass 62 bits")
    value, product = np.zeros((len(a), len(b)), np.int64), 1
    for p in moduli(bound):
        ra, rb = _centred(a, p).astype(np.float32), _centred(b, p).astype(np.float32)
        residue = np.zeros(value.shape, np.int32)
        for i in range(0, dims, CHUNK):
            part = ra[:, i:i + CHUNK] @ rb[:, i:i + CHUNK].T
            residue = np.remainder(residue + part.astype(np.int32), p)
        digit = np.remainder((residue - np.remainder(value, p)) * pow(product, -1, p), p)
        value += _centred(digit, p) * product
        product *= p
    return value


def first(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` greatest scores of each row, of equal ones the first columns; ``NONE`` never counts."""
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        row, column = np.nonzero((scores >= least) & (scores > NONE))
    else:
        row, column = np.nonzero(scores > NONE)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept]


def in_windows(scores: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and column of the ``k`` greatest scores between ``low`` and ``high`` in the window's row."""
    order = np.argsort(-scores, axis=1, kind="stable")
    falling = np.take_along_axis(scores, order, 1)
    found = [(w, order[r, at]) for w, (r, lo, hi) in enumerate(zip(row, low, high, strict=True))
             for begin in [int(np.searchsorted(-falling[r], -hi, "left"))]
             for at in range(begin, min(begin + k, scores.shape[1])) if falling[r, at] >= lo]
    return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """The lists of a column as rows, padded with zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _cell(anchors: pa.Table, rows: pa.Table) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Columns of both sides as arrays, the rows by id."""
    rows = rows.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
    dims = max([len(v) for t in (anchors, rows) for v in t["v"]] or [0])
    sides = [{c: t[c].to_numpy() for c in ("uid", "vec_id", "label")} | {"v": _matrix(t["v"], dims)} for t in (anchors, rows)]
    return sides[0], sides[1]


def _positives(k: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, r = _cell(anchors, rows)
        out: list[tuple] = []
        for label in np.unique(a["label"]):
            mine, theirs = np.nonzero(a["label"] == label)[0], np.nonzero(r["label"] == label)[0]
            for i in range(0, len(mine), STRIP):
                strip = mine[i:i + STRIP]
                scores = exact_scores(a["v"][strip], r["v"][theirs])
                scores[a["uid"][strip][:, None] == r["uid"][theirs][None, :]] = NONE
                at, column = first(scores, k)
                out.append((a["uid"][strip][at], r["uid"][theirs][column], r["vec_id"][theirs][column], scores[at, column]))
        return _table(["auid", "uid", "vec_id", "score"], out)
    return cell


def _negatives(k: int, least: int, most: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, r = _cell(anchors, rows)
        positives = anchors["positives"].to_pylist()
        out: list[tuple] = []
        for i in range(0, len(positives), STRIP):
            strip = slice(i, i + STRIP)
            scores = exact_scores(a["v"][strip], r["v"])
            scores[a["label"][strip][:, None] == r["label"][None, :]] = NONE
            wanted = [(at, p["uid"], p["score"]) for at, ps in enumerate(positives[strip]) for p in ps]
            row, puid, score = (np.array([w[c] for w in wanted], np.int64) for c in range(3))
            window, column = in_windows(scores, row, -(-least * score // 100), most * score // 100, k)
            out.append((a["uid"][strip][row[window]], puid[window], r["uid"][column], r["vec_id"][column], scores[row[window], column]))
        return _table(["auid", "puid", "uid", "vec_id", "score"], out)
    return cell


def _table(names: list[str], parts: list[tuple]) -> pa.Table:
    columns = zip(*parts, strict=True) if parts else [[] for _ in names]
    return pa.table({n: pa.array(np.concatenate(c) if c else [], pa.int64()) for n, c in zip(names, columns, strict=True)})


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(uid, vec_id, label, v)`` of the rows that take part, components as ``floor(scale * x)``."""
    fine = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
            & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def whole(x: Column) -> Column:
        scaled = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.when(F.abs(scaled) < 2**31, scaled.cast("int")).otherwise(F.raise_error(F.lit("component beyond 32 bits")).cast("int"))

    return (vectors.select("vec_id", "label", "embedding").where(fine)
            .select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"),
                    F.col("label").cast("long").alias("label"), F.transform("embedding", whole).alias("v")))


def _cells(anchors: DataFrame, rows: DataFrame, grid: tuple[int, int], run, schema: str) -> DataFrame:
    """``run`` on every pair of a block of anchors and a block of rows."""
    def dealt(df: DataFrame, own: str, other: str, n_own: int, n_other: int) -> DataFrame:
        return df.select(*[F.col(c).alias(c) for c in df.columns], F.pmod(F.xxhash64("uid"), F.lit(n_own)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    left, right = dealt(anchors, "ab", "rb", *grid), dealt(rows, "rb", "ab", *grid[::-1])
    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(run, schema)


def _best(found: DataFrame, group: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least: int = LEAST, most: int = MOST, scale: int = SCALE, block: tuple[int, int] = (ANCHORS, ROWS)) -> DataFrame:
    """Hard negatives of ``vectors (vec_id, label, embedding)`` for the rows where ``is_anchor (vec_id, label)`` holds.

    ``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``: for each of an anchor's first ``positives`` rows of its
    label the first ``negatives`` rows of other labels that score between
    ``least`` and ``most`` hundredths of the positive.
    """
    importable(vectors.sparkSession)
    rows = written(quantised(vectors, scale), "vectors")
    anchors = rows.where(is_anchor)
    grid = tuple(max(1, -(-df.count() // size)) for df, size in zip((anchors, rows), block, strict=True))
    near = _best(_cells(anchors, rows, grid, _positives(positives), "auid long, uid long, vec_id long, score long"),
                 ["auid"], positives)
    near = written(near.select("auid", "uid", "vec_id", "score"), "positives")
    wanted = near.groupBy("auid").agg(F.collect_list(F.struct("uid", "score")).alias("positives"))
    asking = anchors.join(wanted.withColumnRenamed("auid", "uid"), "uid")
    hard = _best(_cells(asking, rows, grid, _negatives(negatives, least, most), "auid long, puid long, uid long, vec_id long, score long"),
                 ["auid", "puid"], negatives)
    return (hard.select("auid", "puid", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(near.select("auid", F.col("uid").alias("puid"), F.col("vec_id").alias("positive_id"),
                              F.col("score").alias("positive_score")), ["auid", "puid"])
            .join(anchors.select(F.col("uid").alias("auid"), F.col("vec_id").alias("anchor_id")), "auid")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
