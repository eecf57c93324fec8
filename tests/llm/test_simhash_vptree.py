"""SimHash near-duplicates against brute force on all pairs."""

import random
import re

import pytest
import xxhash

from costlens.llm import simhash_vptree as S
from costlens.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def fingerprint(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = WORD.findall(low)
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(nodes, near):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, x in enumerate(nodes):
        for y in nodes[i + 1:]:
            if near(x, y):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    group = roots(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    return sorted(((i, f"{f:016x}", least.get(group[f])) for (i, _), f in zip(rows, prints)), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"W{i}é" for i in range(400)]
    rows, n = [], 0
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 150))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (None, "one"),
             (None, "only null ids here " * 9), (n + 5, "x " * 40_000), (n + 5, "x " * 40_000)]
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1)
    out = S.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("shard,chunk", [(4, 16_000), (8, 5), (10_000, 7)])
def test_shards_and_chunks_lose_no_link(spark, shard, chunk):
    rng = random.Random(shard)
    prints = set()
    for _ in range(60):  # clusters whose members drift apart bit by bit
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            prints.add(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = components(S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, shard, chunk))
    got = {r["node"]: r["root"] for r in got.collect()}
    want = roots(sorted(signed), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {x: got.get(x, x) for x in signed} == want


def test_keep_one_row_of_each_group(spark):
    rows = [(5, "same words here now", "a"), (3, "same words here now", "b"), (3, "same words here now", "b"),
            (None, "same words here now", "c"), (9, "something else entirely different", "d"), (None, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FP string")
    out = S.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([rows[1], rows[4], rows[5]], key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    got = components(spark.createDataFrame(path + star + [(7, 7), (None, 5)], "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(61)} | {(1000 + i, 1000) for i in range(80)}
