"""Collocations against plain counts."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from costlens.llm import collocations as C

SCHEMA = "lang string, text string, Phrase string, doc_id long"


def pieces(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def counts(rows):
    f, n = Counter(), Counter()
    for lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            for k in range(1, 6):
                f.update((lang, *ws[i:i + k]) for i in range(len(ws) - k + 1))
    return f, n


def brute(rows, least, top):
    f, n = counts(rows)
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = {}
    for q, a in cands.items():
        for k in range(2, len(q) - 1):
            for i in range(1, len(q) - k + 1):
                p = (q[0], *q[i:i + k])
                inside[p] = max(inside.get(p, 0), a)
    out = {}
    for p, a in cands.items():
        if inside.get(p, 0) < a:
            cuts = [(f[p[:k + 1]], f[(p[0], *p[k + 1:])]) for k in range(1, len(p) - 1)]
            score, _, (l, r) = min((Fraction(1000 * a * n[p[0]], l * r).__floor__(), k, (l, r)) for k, (l, r) in enumerate(cuts))
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def rows_of(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "York", "new", "é", "漢字", "x\x01", "x", "x\x00y", "ß", "K", "\x1c", " ", "z\x0by", "rare", "[a]", "%", "_"]
    out = []
    for i in range(n):
        ws = [rng.choice(words[:rng.choice([4, 8, len(words)])]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! "]) for w in ws)
        text += rng.choice(["", "Alpha beta gamma delta epsilon zeta eta. ", "only ever together"])
        out.append((rng.choice(["en", "en", "en", "de fr", "", None, "und"]), text, "x", i))
    return [*out, out[0], out[0], (None, None, None, None), ("en", "", "", 1), ("en", "word " * 3000, "", 2), ("xx", " \t\n", "", 3)]


@pytest.mark.parametrize("seed,held,block,partitions", [(1, 10**6, 10**6, None), (2, 50, 7, 5), (3, 400, 1, 40)])
def test_matches_plain_counts(spark, seed, held, block, partitions):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = C.collocations(df, least=4, top=60, held=held, block=block, partitions=partitions)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(map(tuple, out.collect()))
    assert got == brute(rows, 4, 60) and len(got) > 100


def test_every_flow(spark):
    rows = rows_of(4)
    f, n = counts(rows)
    got = {(r["lang"], r["k"], r["phrase"]): r["f"] for r in C.frequent(spark.createDataFrame(rows, SCHEMA), 3, held=100, block=20).collect()}
    want = {(p[0], len(p) - 1, " ".join(p[1:])): a for p, a in f.items() if a >= 3}
    assert {k: v for k, v in got.items() if k[1]} == want
    assert {k[0]: v for k, v in got.items() if not k[1]} == {lang: x for lang, x in n.items() if x}


def test_counts_past_64_bits(spark):
    big = [("en", 0, "", 10**16), ("en", 1, "a", 3 * 10**15 + 7), ("en", 1, "b", 10**15 + 1), ("en", 2, "a b", 9 * 10**14 + 13)]
    got = C.scored(spark.createDataFrame(big, "lang string, k int, phrase string, f long")).first()
    l, r, a, n = big[1][3], big[2][3], big[3][3], big[0][3]
    assert got["score"] == 1000 * a * n // (l * r) and 1000 * a * n > 2**64


def test_unary_paths(spark):
    line = "p1 p2 p3 p4 p5 p6 p7 p8 p9"
    rows = [("en", line, "", 1)] * 3 + [("en", "q1 q2 q3 q4 q5", "", 1)] * 3 + [("en", "r1 r2 r3 r4 r5 r6", "", 1)] * 3
    rows += [("en", "r2 r3 r4 r5 s6", "", 1)] * 3 + [("en", "o o o o o o o o", "", 1)]
    ring = " ".join(["u v w x y z"] * 3)
    got = C.paths(C.frequent(spark.createDataFrame([*rows, ("de", ring, "", 1)], SCHEMA), 3))
    found = {r["phrase"]: r["f"] for r in got.where("lang = 'en'").collect()}
    assert found == {line: 3, "q1 q2 q3 q4 q5": 3, "r1 r2 r3 r4 r5": 3, "r2 r3 r4 r5 r6": 3, "r2 r3 r4 r5 s6": 3, "o o o o o": 4}
    assert got.where("lang = 'de'").count() > 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.collocations(empty).count() == 0 and C.paths(C.frequent(empty)).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None, "", 1)], SCHEMA).where(F.lit(True))).count() == 0
