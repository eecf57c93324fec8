"""Hard negatives against plain integer arithmetic."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from costlens.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<double>, UID string, score string"
def anchor():
    return F.col("vec_id") % 5 == 0


def brute(rows, positives=H.POSITIVES, negatives=H.NEGATIVES):
    fine = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v, *_ in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, y, v) in enumerate(fine):
        if i % 5:
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for m, (j, z, w) in enumerate(fine) if m != n)
        for s, p, _ in [o for o in others if o[2] == y][:positives]:
            hard = [o for o in others if o[2] != y and 50 * -s <= 100 * -o[0] <= 95 * -s][:negatives]
            out += [(i, p, k, j, -s, -t) for k, (t, j, _) in enumerate(hard, 1)]
    return sorted(out)


def rows_of(seed, n=150, dims=9):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, 0 if rng.random() < 0.4 else rng.randrange(4), [round(x + rng.gauss(0, 0.7), 2) for x in c], "x", None))
    return rows


def defects():
    return [(200, None, [1.0], "", ""), (205, 1, None, "", ""), (None, 1, [1.0] * 9, "", ""), (210, 1, [1.0, None], "", ""),
            (215, 1, [float("nan")] * 9, "", ""), (220, 1, [float("inf")] * 9, "", ""), (225, 1, [], "", ""), (230, 1, [2.0], "", ""),
            (235, 2, [0.5, -0.5, 0.001], "", ""), (240, 3, [1.0] * 12, "", "")]


@pytest.mark.parametrize("block", [(10_000, 10_000), (4, 16)])
def test_matches_plain_arithmetic(spark, block):
    rows = rows_of(1) + defects()
    rows += [rows[0], rows[5], rows[5], rows[7]]
    out = H.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), anchor(), block=block)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, out.collect()))
    # an anchor's positives that are copies of one row are told apart in neither
    assert got == brute(rows) and len(got) > 100


def test_float_vectors_many_ties_and_few_candidates(spark):
    rows = [(i, i % 2, [1.0, 0.5 if i % 2 else 0.25], "", "") for i in range(40)] + [(100, 7, [1.0, 1.0], "", "")]
    df = spark.createDataFrame(rows, SCHEMA.replace("double", "float"))
    assert sorted(map(tuple, H.hard_negatives(df, anchor(), block=(3, 7)).collect())) == brute(rows)


def test_empty_table_and_no_anchor(spark):
    df = spark.createDataFrame(rows_of(2, 20), SCHEMA)
    assert H.hard_negatives(df.limit(0), anchor()).count() == 0
    assert H.hard_negatives(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("dims,most", [(1, 3), (64, 158), (200, 1000), (130, 2**20), (3, 2**28), (64, 2**27)])
def test_scores_are_exact(dims, most):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-most, most + 1, (7, dims)), rng.integers(-most, most + 1, (11, dims))
    a[0], b[0], b[1] = most, most, -most
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    assert H.exact_scores(a, b).tolist() == want


def test_scores_too_large_are_refused():
    with pytest.raises(OverflowError):
        H.exact_scores(np.full((1, 64), 2**30), np.full((1, 64), 2**30))


def test_component_too_large_is_refused(spark):
    df = spark.createDataFrame([(0, 1, [1e30], "", "")], SCHEMA)
    with pytest.raises(Exception, match="beyond 32 bits"):
        H.hard_negatives(df, anchor()).collect()
