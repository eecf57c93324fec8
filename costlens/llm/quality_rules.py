"""Quality rules whose cutoffs carry a statistical guarantee.

A rule rejects a document when one of its measures reaches a cutoff.  Each
rule has an ordered list of candidate cutoffs, fixed in advance, from lenient
to strict.  A labelled holdout (quality 1 = good) decides which candidates may
be used, stratum by stratum:

* of the good documents of a stratum, ``n`` in all, a candidate rejects ``k``;
* the exact binomial tail ``P(Bin(n, alpha / R) <= k)`` is the p-value of the
  hypothesis "this candidate falsely rejects more than alpha / R of the good
  documents" (inverting it gives the Clopper-Pearson bound);
* candidates of one rule are tested from lenient to strict and the first
  failure ends the rule's list (fixed-sequence testing), so a list needs no
  correction; the S strata times R rules are corrected by Bonferroni, each at
  ``delta / (S * R)``.

With probability 1 - delta, every stratum then falsely rejects at most
``alpha`` of its good documents over all rules together (union over R rules).
Among the certified candidates of a rule the one with the largest surplus of
bad over good holdout rejections is used, the most lenient on ties, and none
if no candidate has a surplus.  A stratum with too few labelled documents
certifies nothing, and nothing is rejected there beyond the base rules.

Strata are the languages, each with its own guarantee; S counts those among the
labelled documents that pass the base rules, and always ``other``.  A language without labels of its
own, or with too few, has no cutoff, so the table of cutoffs has a row for some
hundreds of labelled documents at most.

Defined cases: a null or empty text has no words and fails the base rules;
a null ``lang`` belongs to the stratum ``other``; a label row with a null
``doc_id`` or ``quality`` is ignored; a document labelled twice counts as good
if any label says so; without labels only the base rules reject; repeated
document rows are judged alike and each counts in the holdout; texts of any
length are measured whole; columns other than those named are only carried, so
their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .text import SPACES, indices, let, once, whole, words

ALPHA, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
NOT_SYMBOLS, NOT_SPACE = r"[^#*$%&|<>]+", r"[^\x20\x09-\x0D]"

#: rule -> (measure, reject at or above / at or below the cutoff, candidates from lenient to strict)
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("symbols_per_word", "above", (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeats": ("repeat_share", "above", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "long_words": ("chars_per_word", "above", (20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0)),
    "dup_lines": ("dup_lines_per_word", "above", (0.5, 0.4, 0.3, 0.2, 0.1)),
}


def _repeat_words(ws: Column) -> Column:
    """Words inside a three-word window that occurs twice or more in the text.

    Windows are compared by hash first; a text without equal hashes has no
    repeat.  Else windows are sorted by hash and neighbours compared in full.
    """
    hashes = F.transform(indices(F.size(ws) - 2), lambda i: F.xxhash64(
        F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))

    def repeated(s: Column) -> Column:
        def same(j: Column, k: Column) -> Column:
            a, b = F.get(s, j), F.get(s, k)
            return F.coalesce((a["h"] == b["h"]) & F.forall(
                F.sequence(F.lit(0), F.lit(2)), lambda d: F.get(ws, a["i"] + d) == F.get(ws, b["i"] + d)), F.lit(False))
        return F.sort_array(F.transform(
            F.filter(indices(F.size(s)), lambda j: same(j, j - 1) | same(j, j + 1)),
            lambda j: F.get(s, j)["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(indices(F.size(p)), F.lit(0), lambda acc, j: acc + F.least(
            F.lit(3), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(3))))

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return (F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
                .otherwise(let(let(ordered, repeated), covered)))

    return let(hashes, count).cast("long")


def measures(text: Column) -> Column:
    """Struct of the counts that the rules use, from the whole text."""
    t = whole(text)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    return let(words(t), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(ws).alias("n_repeat_words")))


def stratum(lang: Column) -> Column:
    return F.coalesce(lang, F.lit("other"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def _measure(m: Column, name: str) -> Column:
    top = {"symbols_per_word": m["n_symbols"], "repeat_share": m["n_repeat_words"],
           "chars_per_word": m["word_chars"], "dup_lines_per_word": m["n_dup_lines"]}[name]
    return top / F.greatest(m["n_words"], F.lit(1)).cast("double")


def _reaches(value: Column, side: str, cutoff: Column) -> Column:
    return value >= cutoff if side == "above" else value <= cutoff


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """``P(Bin(n, p) <= k)``; 1 where ``k`` exceeds the mean, which no test at hand could pass."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k, F.lit(1))),
        F.struct((n * math.log1p(-p)).alias("log"), F.exp(n * math.log1p(-p)).alias("sum")),
        lambda acc, j: let(acc["log"] + F.log((n - j + 1) / j.cast("double") * (p / (1 - p))),
                           lambda lg: F.struct(lg.alias("log"), (acc["sum"] + F.exp(lg)).alias("sum"))),
        lambda acc: acc["sum"])
    return (F.when(k > n * p, F.lit(1.0)).when(k < 1, F.exp(n * math.log1p(-p)))
            .otherwise(F.least(step, F.lit(1.0))))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a certified cutoff: the chosen cutoff of each rule, null where none is certified.

    ``measured`` has ``doc_id``, ``stratum`` and the struct ``m`` of :func:`measures`.
    """
    marks = (labels.where("doc_id is not null and quality is not null")
             .groupBy("doc_id").agg((F.max("quality") == 1).alias("good")))
    held = measured.where(~base_failed(F.col("m"))).join(marks, "doc_id")
    counted = [F.sum(F.col("good").cast("long")).alias("n")]
    for rule, (measure, side, grid) in RULES.items():
        for i, cut in enumerate(grid):
            hit = _reaches(_measure(F.col("m"), measure), side, F.lit(cut))
            counted.append(F.sum((hit & F.col("good")).cast("long")).alias(f"{rule}_{i}_good"))
            counted.append(F.sum((hit & ~F.col("good")).cast("long")).alias(f"{rule}_{i}_bad"))
    counts = written(held.groupBy("stratum").agg(*counted), "quality-counts")
    level = delta / ((counts.where("stratum != 'other'").count() + 1) * len(RULES))

    chosen = []
    for rule, (_, _, grid) in RULES.items():
        tests = F.array(*[F.struct(
            F.lit(cut).alias("cut"), F.lit(-i).alias("rank"),
            binomial_tail(F.col("n"), F.col(f"{rule}_{i}_good"), alpha / len(RULES)).alias("p"),
            (F.col(f"{rule}_{i}_bad") - F.col(f"{rule}_{i}_good")).alias("gain"))
            for i, cut in enumerate(grid)])
        # Stricter candidates reject a superset, so their p-values only grow:
        # all that pass come before the first failure.
        passed = F.filter(tests, lambda x: (x["p"] <= level) & (x["gain"] > 0))
        best = F.array_max(F.transform(passed, lambda x: F.struct(x["gain"], x["rank"], x["cut"])))
        chosen.append(best["cut"].alias(rule))
    return counts.select("stratum", *chosen).where(F.coalesce(*RULES).isNotNull())


def _rejected(m: Column, cuts: Column) -> Column:
    """True where a rule of the stratum rejects; a missing cutoff never does."""
    hit = F.lit(False)
    for rule, (name, side, _) in RULES.items():
        hit = hit | F.coalesce(_reaches(_measure(m, name), side, cuts[rule]), F.lit(False))
    return hit


def judged(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``measured`` with the boolean columns ``base_failed`` and ``kept``.

    The cutoffs are broadcast: each row stands for hundreds of labelled documents.
    """
    cuts = cutoffs(measured, labels, alpha, delta).select(
        F.col("stratum").alias("_stratum"), F.struct(*RULES).alias("_cuts"))
    return (measured.join(F.broadcast(cuts), F.col("stratum") == F.col("_stratum"), "left")
            .withColumn("base_failed", base_failed(F.col("m")))
            .withColumn("kept", ~F.col("base_failed") & ~_rejected(F.col("m"), F.col("_cuts")))
            .drop("_stratum", "_cuts"))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``stratum`` and measures of every document, written once (no text is kept)."""
    slim = docs.select("doc_id", stratum(F.col("lang")).alias("stratum"), F.col("text"))
    return written(once(slim, "m", measures(F.col("text"))).drop("text"), "quality-measures")


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A verdict row for every document row."""
    out = judged(measure(docs), labels, alpha, delta)
    return out.select("doc_id", "m.*", "base_failed", "kept", "stratum")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged.

    The cutoffs come from measures of all rows; the rows themselves are then
    measured again where they lie, so no text is shuffled.
    """
    cuts = written(cutoffs(measure(docs), labels, alpha, delta), "quality-cutoffs")
    names = docs.columns
    whole_rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                             stratum(F.col("lang")).alias("stratum"))
    seen = once(whole_rows, "m", measures(F.col("row")["text"]))
    cuts = cuts.select(F.col("stratum").alias("_stratum"), F.struct(*RULES).alias("_cuts"))
    return (seen.join(F.broadcast(cuts), F.col("stratum") == F.col("_stratum"), "left")
            .where(~base_failed(F.col("m")) & ~_rejected(F.col("m"), F.col("_cuts")))
            .select(*[F.col("row")[c].alias(c) for c in names]))
