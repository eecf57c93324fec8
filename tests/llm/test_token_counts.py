"""Token counts against the libraries on whole texts, whatever the pieces and calls."""

import random

import public_tokenizers as T
import pytest
import sentencepiece
import tokenizers

from costlens.llm import token_counts as C

SCHEMA = "doc_id long, text string, n_tokens string"
BYTES, WORDS, PIECES = T.path("byte_bpe_50k.json"), T.path("word_bpe_49k.json"), T.path("piece_bpe_32k.model")


def plain(path):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    made = tokenizers.Tokenizer.from_file(path)
    return lambda t: len(made.encode(t, add_special_tokens=False).ids)


def texts(seed):
    rng = random.Random(seed)
    words = ["the", "a", "I'll", "don't", "naïve", "straße", "漢字", "かな、", "了。", "x1", "3.14", "<|endoftext|>", "<|startoftext|>", "  ",
             "\n", "\t", "'s", " ", "\x1c", "😀", "é", "▁", "WE'RE", "--", "s", "'", "ſ", "​"]
    out = []
    for _ in range(250):
        out.append("".join(rng.choice(words) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(0, 60))))
    return [*out, "", " ", "<|endoftext|>", "a<|endoftext|>b c", "x" * 3000, "word " * 5000, "漢字。" * 2000, " " * 300 + "a", "a " * 3]


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
@pytest.mark.parametrize("long,size", [(1, 1), (7, 40), (64, 1000), (C.LONG, C.BATCH_BYTES)])
def test_pieces_change_no_count(path, long, size):
    with open(path, "rb") as f:
        made, want = C.Counter(path[path.rindex("."):], f.read()), plain(path)
    some = texts(long)
    assert made.counts(some, long, size) == [want(t) for t in some]


def test_boundaries_are_used():
    assert C.split_at("ab cd ef", C.BEFORE_SPACE, 1) == ["ab", " cd", " ef"]
    assert C.split_at("ab cd ef", C.SINGLE_SPACE, 1) == ["ab", "cd", "ef"]
    assert C.split_at("ab cd", None, 1) == ["ab cd"] and C.split_at("abcdef", C.BEFORE_SPACE, 2) == ["abcdef"]
    for path, boundary in ((BYTES, C.BEFORE_SPACE), (WORDS, None), (PIECES, C.SINGLE_SPACE)):
        with open(path, "rb") as f:
            assert C.Counter(path[path.rindex("."):], f.read()).boundary is boundary


def test_calls_are_balanced_by_bytes():
    with open(BYTES, "rb") as f:
        made = C.Counter(".json", f.read())
    sizes, encode = [], made.encode
    made.encode = lambda call: sizes.append(sum(len(t.encode()) for t in call)) or encode(call)
    rng = random.Random(3)
    some = [f"{i} " + "some words é " * rng.choice([1, 1, 1, 400]) for i in range(400)]
    made.counts([*some, *some], 500, 4000)
    assert all(4000 <= s < 4000 + 600 * 2 for s in sizes[:-1]) and sum(sizes) < 1.01 * sum(len(t.encode()) for t in some)


def test_equal_pieces_are_encoded_once():
    for path in (BYTES, PIECES):
        with open(path, "rb") as f:
            made = C.Counter(path[path.rindex("."):], f.read())
        calls, encode, want = [], made.encode, plain(path)
        made.encode = lambda call: calls.extend(call) or encode(call)
        some = [" ".join(f"word{i % 50} {n}" for i in range(300)) for n in range(20)]
        assert made.counts(some) == [want(t) for t in some] and len(calls) <= 100
        assert made.counts([t[:500] for t in some] + some) and len(calls) <= 140  # remembered from call to call


@pytest.mark.parametrize("cache,longest", [(C.CACHE, C.LONGEST), (3, 64), (50, 2)])
def test_marks_join_and_cache_change_no_count(monkeypatch, cache, longest):
    monkeypatch.setattr(C, "CACHE", cache)
    monkeypatch.setattr(C, "LONGEST", longest)
    rng = random.Random(cache)
    parts = [*" .,;:!?\n\r\t'", "  ", "...", ". ", "?!", "ab", "Z9", "7", "é", "ß.", "'s", "'ll", "-", "(", "\u00a0", "\u2028", "\x85", "了", "。",
             "\x1c", "<|endoftext|>", "<|endoftext|>.", "²", "٣", "e\u0301", "😀", "\x00"]
    some = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(3000)] + ["x" * 9000 + ".", ".x" * 9000, "\n" * 9000]
    for t in some:
        assert C.PIECE.findall(t) == [p for p in C.BEFORE_SPACE.split(t) if p]
    with open(BYTES, "rb") as f:
        content = f.read()
    made, want = C.Counter(".json", content), plain(BYTES)
    for start in range(0, len(some), 400):
        assert made.counts(some[start:start + 400], 100) == [want(t) for t in some[start:start + 400]]


def test_missing_bytes_are_counted_as_the_library_does(tmp_path):
    path = tmp_path / "few.json"
    alphabet = "abcdefgĠ."
    bpe = tokenizers.models.BPE({c: i for i, c in enumerate([*alphabet, "Ġa"])}, [("Ġ", "a")])
    few = tokenizers.Tokenizer(bpe)
    few.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    few.save(str(path))
    made, want = C.Counter(".json", path.read_bytes()), plain(str(path))
    some = ["ab ab. zz ac xx a b.c ad", " a a ab bx gg", "zz zz"]
    assert made.boundary is C.BEFORE_SPACE and made.counts(some) == [want(t) for t in some]


@pytest.mark.parametrize("path", [BYTES, PIECES])
def test_whole_table(spark, path):
    rows = [(i, t, "x") for i, t in enumerate(texts(9))] + [(None, "hello world", None), (9000, None, ""), (9001, "long text here " * 30_000, "")]
    rows.append(rows[0])
    df, want = spark.createDataFrame(rows, SCHEMA).repartition(3), plain(path)
    out = C.token_counts(df, path, limit=40)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    exact = [(i, len((t or "").encode()), n := want(t or ""), n > 40) for i, t, _ in rows]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(exact, key=repr)
    assert C.token_counts(df.limit(0), path).count() == 0


def test_unknown_file(spark, tmp_path):
    other = tmp_path / "ranks.txt"
    other.write_text("x")
    with pytest.raises(Exception, match="neither"):
        C.token_counts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(other)).collect()
