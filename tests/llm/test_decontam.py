"""Benchmark decontamination against brute-force containment."""

import random
import re

import pytest

from costlens.llm import decontam as D

SCHEMA, ITEMS = "doc_id long, text string, ITEM_ID string", "item_id long, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(text, k):
    w = words(text)
    return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items):
    best = {}
    for d, t, _ in docs:
        for i, u in items:
            k = min(5, len(words(u)))
            s, b = shingles(t, k) if k else set(), shingles(u, k) if k else set()
            if b and 100 * len(s & b) >= 80 * len(b):
                best[d, i] = max(best.get((d, i), (0,)), (len(s & b) / len(b), len(b), len(s & b)))
    return sorted(((d, i, n, k, c) for (d, i), (c, n, k) in best.items()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)] + ["Éa", "ß", "x-y"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randint(1, 40))) for i in range(40)] + [(90, None), (91, ""), (92, "!!"), (None, say(20)), (3, say(9))]
    items.append(items[0])
    docs = []
    for d in range(80):
        parts = [say(rng.randint(0, 60))]
        for i in rng.sample(range(40), rng.randint(0, 3)):
            w = items[i][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "changed"
            parts += [" ".join(w).upper() if rng.random() < .3 else ",\n".join(w), say(rng.randint(0, 30))]
        docs.append((d, " ".join(parts), "x"))
    docs += [(100, None, None), (101, "", ""), (102, items[5][1], ""), (None, items[7][1], ""), (103, say(30_000) + " " + items[8][1], "")]
    docs.append(docs[0])
    out = D.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(docs, items)


def test_short_items_are_found_inside_long_texts(spark):
    items = [(1, "alpha beta gamma"), (2, "solo"), (3, "two words"), (4, "one two three four five six")]
    docs = [(1, "so it was: Alpha, beta gamma " + "word " * 4000, ""), (2, "alpha beta delta gamma", ""), (3, "a solo part", ""), (4, "two", ""),
            (5, "in two words, here", ""), (6, "alpha beta gamma", "")]
    out = D.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS))
    assert sorted(tuple(r)[:2] for r in out.collect()) == [(1, 1), (3, 2), (5, 3), (6, 1)]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(docs, items)


def test_stage_drops_whole_documents_and_keeps_clean_ones(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, "so " + item + " it is", "a"), (1, "clean under the same id", "b"), (None, item, "c"), (None, "clean", None)]
    df = spark.createDataFrame(docs, SCHEMA)
    out = D.drop_contaminated(df, spark.createDataFrame([(1, item)], ITEMS))
    assert out.columns == df.columns
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([docs[1], docs[3]], key=repr)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f", "")], SCHEMA), spark.createDataFrame([], ITEMS)
    assert D.contaminated(docs, items).count() == 0 and D.drop_contaminated(docs, items).count() == 1
    assert D.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0
