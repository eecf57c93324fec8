"""The pipeline against a plain version of its stages on a small corpus."""

import base64
import hashlib
import random
import re

import public_tokenizers as T
import tiktoken

import corpus_pipeline as C
from tests.llm import test_decontam as leaks
from tests.llm import test_pii as private
from tests.llm import test_simhash_vptree as copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def keeps(text, bad_symbols):
    w = WORD.findall(text or "")
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in windows if windows.count(x) > 1}
    covered = {j for i, x in enumerate(windows) if x in twice for j in range(i, i + 3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return not (len(w) < 50 or 100 * len(covered) > 50 * len(w) or bad_symbols and symbols >= 0.3 * len(w))


def redact(text):
    out, at = "", 0
    for start, _, end, kind, _ in sorted(private.base(text)):
        if start >= at:
            out += text[at:start] + MARKS[kind]
        at = max(at, end)
    return out + text[at:]


def brute(docs, items):
    docs = [d for d in docs if keeps(d[1], True)]
    prints = {d[:2]: copies.fingerprint(d[1]) for d in docs}
    group = copies.roots(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for i, t in sorted(prints):
        first.setdefault(group[prints[i, t]], (i, t))
    docs = set(first.values())
    hit = {d for d, *_ in leaks.brute([(i, t, "") for i, t in docs], items)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.path("byte_bpe_50k.tiktoken"), "rb"))}
    bpe = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for i, t in docs:
        if i not in hit:
            clean = redact(t)
            ids = bpe.encode_ordinary(clean)
            out.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(clean.encode())))
    return sorted(out)


def test_pipeline_matches_its_plain_version(spark, tmp_path):
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(600)] + ["é", "x-y"]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, say(30)) for i in range(4)]
    docs = []
    for i in range(900):  # good and bad pages enough to certify the symbol rule
        body = say(rng.randint(40, 90))
        if i % 6 == 0:
            body = " ".join(w + rng.choice(["###", "%%"]) for w in body.split())
        elif i % 23 == 0:
            body += f" mail me{i}@home.example or +1 (415) 555-{i:04d}, " + say(5)
        elif i % 29 == 0:
            body += " " + items[i % 4][1]
        elif i % 31 == 0:
            body = say(3) + (" " + say(4)) * 1 + " same again now" * 30
        docs.append((i, body))
    docs += [(1000 + i, docs[5 * i + 1][1] + rng.choice(["", " tail"])) for i in range(30)]
    docs += [(2000, None), (2001, ""), docs[7]]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(900)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, source, str(tmp_path)).columns == source.columns, name
    out = C.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = brute(docs, items)
    assert 300 < len(want) < 850
    assert sorted(tuple(r) for r in out.collect()) == want
