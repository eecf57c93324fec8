"""Byte-level BPE against the tiktoken library, and its own round trip."""

import base64
import hashlib
import random

import public_tokenizers as T
import pytest
import tiktoken

from costlens.llm import bpe as B

PATH = T.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    alphabet = "abcdeét ñß\n\t  '　漢字😀١٢3#$|<>.\x1c ‍﻿"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    out += [chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) * rng.randint(1, 3) for _ in range(300)]
    return out + ["", " ", "<|endoftext|>", "I'll don't WE'RE", "x" * 3000, "ab" * 20_000, " " * 500 + "a", "\r\n\r\n", "▁ĠĊ"]


def test_matches_tiktoken(spark, reference):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "hello world", None), (9000, None, "")]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(((i, reference.encode_ordinary(t or ""), t or "") for i, t, _ in rows), key=repr)
    got = B.encode(df, PATH, T.PATTERN)
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got.collect()), key=repr) == sorted(((i, x) for i, x, _ in want), key=repr)
    back = B.decode(got, PATH, T.PATTERN)
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted(((i, t) for i, _, t in want), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    digests = B.digests(df, PATH, T.PATTERN)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((tuple(r) for r in digests.collect()), key=repr) == sorted(
        ((i, len(x), sha(" ".join(map(str, x)).encode()), sha(t.encode())) for i, x, t in want), key=repr)
    assert B.digests(df.limit(0), PATH, T.PATTERN).count() == 0


def test_every_vocabulary_entry_encodes_to_its_rank():
    entries = B.read_ranks(PATH)
    codec = B.Codec(B.model_of(entries), T.PATTERN)
    assert [codec.bytes[i] for i in range(len(entries))] == entries
    shown = ["".join(B.TO_CHAR[b] for b in e) for e in entries]
    assert codec.pieces.encode(shown, out_type=int) == [[i] for i in range(len(entries))]


def test_a_full_cache_changes_nothing(reference):
    codec = B.Codec(B.model_of(B.read_ranks(PATH)), T.PATTERN)
    for i in range(3):
        codec.known = {f"filler{j}": ("0", 1, b"") for j in range(B.CACHE + i)}
        text = f"some words {i} " + "y" * 100 * i
        n, ids, _ = next(codec.digests([text]))
        want = reference.encode_ordinary(text)
        assert (n, ids) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
