"""Quality rules: measures against plain counts, the binomial tail, the choice of cutoffs."""

import math
import random
import re

import pytest

from costlens.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, n_words long"
LABELS = "doc_id long, quality int, toxic int"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures(spark):
    rng = random.Random(1)
    bits = ["a", "b", "é😀", "#*", "<|>", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", " ", "\xa0", "word", "\x1c"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " \n ", "one", "a b c", "a b c a b c", "a a a a", "x " * 60_000, "same line\n" * 5, "\n\n"]
    rows = [(i, t, rng.choice(["en", "xx", None]), 7) for i, t in enumerate(texts)] + [(None, "a b c", None, None), (0, texts[0], "en", 7)]
    out = Q.quality_rules(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], LABELS))
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = []
    for i, t, _, _ in rows:
        m = plain(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        want.append((i, *m, failed, not failed))
    assert sorted((tuple(r)[:8] for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 5, 50, 400) for k in (0, 1, 3, 12, n) if k <= n]
    rows = spark.createDataFrame(cases, "n long, k long")
    from pyspark.sql import functions as F
    got = rows.select("n", "k", Q.binomial_tail(F.col("n"), F.col("k"), 0.05).alias("p")).collect()
    for r in got:
        exact = sum(math.comb(r["n"], j) * 0.05**j * 0.95**(r["n"] - j) for j in range(r["k"] + 1))
        assert r["p"] == pytest.approx(1.0 if r["k"] > r["n"] * 0.05 else exact, rel=1e-9)


def corpus(n, share_bad=6):
    text = lambda i, bad: " ".join(f"w{i}x{j}" + ("###" if bad else "") for j in range(60))
    rows = [(i, text(i, i % share_bad == 0), "en", 1) for i in range(n)]
    return rows, [(i, int(i % share_bad != 0), 0) for i in range(n)]


def test_cutoffs_need_evidence(spark):
    rows, labels = corpus(900)
    docs, good = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    kept = {r["doc_id"]: r["kept"] for r in Q.quality_rules(docs, good).collect()}
    assert all(kept[i] == (i % 6 != 0) for i in kept)             # bad ones go, every good one stays
    few = spark.createDataFrame(labels[:200], LABELS)             # too few labels certify nothing
    assert all(r["kept"] for r in Q.quality_rules(docs, few).collect())
    noisy = spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], LABELS)   # rejecting them would be false
    assert all(r["kept"] for r in Q.quality_rules(docs, noisy).collect())
    odd = spark.createDataFrame(labels + [(None, 1, 0), (0, None, 0), (99999, 0, 0)] + labels[:3], LABELS)
    assert {r["doc_id"]: r["kept"] for r in Q.quality_rules(docs, odd).collect()} == kept


def test_stage_keeps_columns_and_agrees_with_the_verdicts(spark):
    rows, labels = corpus(900)
    rows += [(5000, None, None, None), (None, "w " * 30 + " ".join(f"v{i}" for i in range(80)), "zz", 3), rows[1]]
    docs, good = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    out = Q.keep_good(docs, good)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in Q.quality_rules(docs, good).collect() if r["kept"]]
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted(kept, key=repr)
    assert Q.keep_good(docs.limit(0), good).count() == 0


def test_every_language_certifies_its_own_cutoffs(spark):
    rows, labels = corpus(900)
    small = [(10_000 + i, rows[0][1], "it", 1) for i in range(60)]    # good, though marked like the bad ones
    docs = [(i, t, "pt", n) for i, t, _, n in rows] + small
    good = labels + [(r[0], 1, 0) for r in small]
    kept = {r["doc_id"]: (r["kept"], r["stratum"]) for r in Q.quality_rules(
        spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(good, LABELS)).collect()}
    assert all(kept[i] == (i % 6 != 0, "pt") for i in range(900))
    assert all(kept[r[0]] == (True, "it") for r in small)
