"""Removal of repeated byte strings against brute force; the merge against sorted suffixes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from costlens.llm import bwt_dedup as B

SCHEMA = "doc_id long, text string, data string"


def brute(rows, length):
    datas = [(t or "").encode() for _, t, _ in rows]
    count = Counter(d[i:i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for (doc, _, _), d in zip(rows, datas):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((doc, len(d), int(gone.sum()), len(B.ranges(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, length):
    rng = random.Random(seed)
    say = lambda n, abc="abcdé \n": "".join(rng.choice(abc) for _ in range(n))
    shared = [say(rng.randint(length - 3, 3 * length)) for _ in range(6)]
    rows = []
    for d in range(70):
        parts = [say(rng.randint(0, length))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            k = rng.randint(0, len(s))
            parts += [s[k:] if rng.random() < .3 else s, say(rng.randint(0, 40))]
        rows.append((d, "".join(parts), "x"))
    rows += [(100, "a" * (length + 9), ""), (101, "ab" * length, ""), (102, say(length, "xyz"), ""), (None, rows[3][1], ""),
             (103, None, None), (104, "", ""), (105, "b" * (length - 1), ""), (106, "\0" * (2 * length), "")]
    return rows + [rows[5], rows[5]]


@pytest.mark.parametrize("seed,length,bucket,large", [(1, 400, B.BUCKET, B.LARGE), (2, 40, 3000, 2000), (3, 40, 1 << 20, 1 << 20)])
def test_matches_brute_force(spark, seed, length, bucket, large):
    rows = corpus(seed, length)
    out = B.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), length, bucket, large)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    assert sorted((tuple(r)[:5] for r in out.collect()), key=repr) == brute(rows, length)


def test_long_text_and_empty_table(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    rows = [(1, text + text[:1000], ""), (2, "q" + text[500:2500], "")]
    assert sorted((tuple(r)[:5] for r in B.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows, 400)
    assert B.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_of_pieces_and_of_single_texts_agree(monkeypatch):
    import pyarrow as pa
    rng = random.Random(3)
    texts = [bytes(rng.choices(b"abcdefgh ", k=n)) for n in (5000, 0, 399, 400, 401, 900, 3, 2000, 400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([7] * 9), pa.array(texts)], ["did", "th", "data"])

    def windows():
        out = {}
        for r in pa.Table.from_batches(B._runs(400)([batch])).to_pylist():
            for w in range(r["at"], r["at"] + r["n"]):
                out[r["did"], w] = r["key"]
        return out
    whole = windows()
    assert len(whole) == sum(max(0, len(t) - 399) for t in texts)
    for piece in (1, 700, 1500):
        monkeypatch.setattr(B, "PIECE", piece)
        assert windows() == whole


@pytest.mark.parametrize("seed", range(6))
def test_shard_order_transform_and_merge(seed):
    rng = random.Random(seed)
    segments = list({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(30, 90))) for _ in range(12)} | {b"a" * 50, b"a" * 60})
    half = [segments[:5], segments[5:9], segments[9:]]
    shards = [B.Shard(s) for s in half]
    for own, shard in zip(half, shards):
        # suffixes with their end mark: smaller than any byte, told apart by segment
        suffix = [tuple(x + 1000 for x in s[i:]) + (k,) for k, s in enumerate(own) for i in range(len(s) + 1)]
        order = sorted(range(len(suffix)), key=lambda p: suffix[p])
        assert shard.order.tolist() == order
        place = {p: r for r, p in enumerate(order)}
        assert shard.successors().tolist() == [place[(p + 1) % len(order)] for p in order]
    length = 30
    rank = B.merged_blocks(shards, length)
    at, seen = 0, {}
    for own, shard in zip(half, shards):
        flat = [(s, i) for s in own for i in range(len(s) + 1)]
        for r, p in enumerate(shard.order):
            s, i = flat[p]
            if i + length <= len(s):
                seen.setdefault(s[i:i + length], set()).add(int(rank[at + r]))
        at += len(flat)
    assert all(len(x) == 1 for x in seen.values())  # equal strings share a block
    assert len({next(iter(x)) for x in seen.values()}) == len(seen)  # and different ones do not
    assert [k for k, _ in sorted(seen.items(), key=lambda kv: next(iter(kv[1])))] == sorted(seen)  # blocks are in order
