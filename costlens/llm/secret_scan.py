"""Secret scan over a trigram inverted index.

Every rule is a regular expression.  :func:`trigram_query` derives from it a
Boolean query over trigrams that any match must satisfy: an AND of clauses, a
clause an OR of alternatives, an alternative an AND of trigrams.  The index
holds, for the trigrams that occur in some query, the documents whose
ASCII-folded text contains them.  Postings are intersected per alternative,
alternatives united, clauses intersected; only the documents that remain are
verified with the expression itself.  A rule whose expression has no mandatory
trigram (a run of hexadecimal digits, say) is verified on every document.

Rules ``assign``, ``access`` and ``hex`` are the base; the further ones add
spans of well-known token formats.

Defined cases: null and empty texts have no spans; a rule's matches are found
left to right without overlap, and a match that fails the rule's check is
dropped without a second try; equal rows get equal results, each its own row;
null ids keep their rows; texts of any length are scanned whole; columns other
than those named are not read, so their names cannot clash; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .spans import SPAN, digest, find, redacted
from .text import let, once, text_key, whole

_parser = re._parser  # the standard library's own parse tree of an expression
_constants = re._constants


class Rule(NamedTuple):
    name: str
    pattern: str
    check: Callable[[Column], Column] | None = None


# Expressions of the base rules and of public token formats.
# Bounded repeats stand for "at least n characters" of one character class,
# where the longest run from the leftmost start decides.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE = (
    Rule("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
FORMATS = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + FORMATS

#: More strings than this for one stretch of an expression count as "anything".
MAX_STRINGS = 64

Clause = frozenset[frozenset[str]]


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses of trigrams, over lower-cased text, that every match satisfies; none: no constraint."""
    clauses: list[Clause] = []

    def close(strings: set[str]) -> None:
        alternatives = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
        if strings and all(alternatives):  # an alternative that asks for more than another adds nothing
            clauses.append(frozenset(a for a in alternatives if not any(b < a for b in alternatives)))

    def strings_of(node) -> set[str] | None:
        """All strings a node can match, or None where they are too many."""
        op, arg = node
        if op is _constants.LITERAL:
            return {chr(arg).lower()}
        if op is _constants.IN:
            out: set[str] = set()
            for kind, value in arg:
                if kind is _constants.LITERAL:
                    out.add(chr(value).lower())
                elif kind is _constants.RANGE and value[1] - value[0] < MAX_STRINGS:
                    out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
            return out if len(out) <= 8 else None
        if op is _constants.SUBPATTERN:
            return sequence(arg[-1])
        if op is _constants.BRANCH:
            parts = [sequence(b) for b in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner = sequence(body)
            if inner is None or high > 2:
                return None
            return {"".join(p) for n in range(low, high + 1) for p in product(inner, repeat=n)}
        return {""} if op is _constants.AT or op is _constants.ASSERT_NOT else None

    def sequence(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            more = strings_of(node)
            if more is None or len(out) * len(more) > MAX_STRINGS:
                return None
            out = {a + b for a in out for b in more}
        return out

    run: set[str] = {""}
    for node in _parser.parse(pattern):
        more = strings_of(node)
        if more is not None and len(run) * len(more) <= MAX_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        close(run)
        run = more if more is not None and len(more) <= MAX_STRINGS else {""}
    close(run)
    return clauses


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``(trigram, key)``: the documents that contain each trigram of the rules."""
    listed = F.array(*[F.lit(t) for t in trigrams])
    # Folding all of Unicode can only add postings, never lose an ASCII one.
    held = let(F.lower(whole(F.col("text"))), lambda t: F.filter(listed, lambda g: t.contains(g)))
    return docs.select("key", F.explode(held).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(key, rule)`` for every rule with mandatory trigrams, by intersecting postings."""
    spark = docs.sparkSession
    terms, clauses = [], []
    for rule in rules:
        query = trigram_query(rule.pattern)
        clauses += [(rule.name, len(query))]
        for c, clause in enumerate(query):
            for a, alternative in enumerate(sorted(map(sorted, clause))):
                terms += [(rule.name, c, a, len(alternative), g) for g in alternative]

    def table(rows: list[tuple], names: str) -> DataFrame:
        fields = names.split()
        return spark.range(1).select(F.inline(F.array(*[
            F.struct(*[F.lit(v).alias(n) for v, n in zip(row, fields, strict=True)]) for row in rows])))

    index = written(postings(docs, sorted({t[-1] for t in terms})), "postings")
    wanted = table(terms, "rule clause alternative needed trigram")
    met = (index.join(wanted, "trigram").groupBy("key", "rule", "clause", "alternative", "needed")
           .agg(F.count("*").alias("n")).where("n = needed").select("key", "rule", "clause").distinct())
    return (met.groupBy("key", "rule").agg(F.count("*").alias("n"))
            .join(table(clauses, "rule clauses"), "rule").where("n = clauses").select("key", "rule"))


def _spans(rule: Rule) -> Column:
    found = find(F.col("text"), rule.pattern)
    return F.filter(found, lambda s: rule.check(s["match"])) if rule.check else found


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, key, <rule> ..)`` with the spans of every rule, for every document row."""
    keyed = docs.select("doc_id", "text", text_key(F.col("doc_id"), F.col("text")).alias("key"))
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    scanned = tuple(r for r in rules if r not in indexed)
    out = once(keyed, "full", F.struct(*[_spans(r).alias(r.name) for r in scanned], F.lit(0).alias("none")))
    out = out.select("doc_id", "key", *[f"full.{r.name}" for r in scanned])
    if indexed:
        found = written(candidates(keyed, indexed).groupBy("key").agg(F.collect_set("rule").alias("rules")), "secret-candidates")
        verified = keyed.select("key", "text").join(found, "key").dropDuplicates(["key"])
        verified = once(verified, "hits", F.struct(*[
            F.when(F.array_contains("rules", r.name), _spans(r)).otherwise(F.array().cast(SPAN)).alias(r.name)
            for r in indexed])).select("key", *[f"hits.{r.name}" for r in indexed])
        out = out.join(verified, "key", "left")
    return out.select("doc_id", "key", *[F.coalesce(r.name, F.array().cast(SPAN)).alias(r.name) for r in rules])


def secrets(docs: DataFrame) -> DataFrame:
    """Counts and digests of the secrets of every document row."""
    found = scan(docs)
    base = [(r.name, F.col(r.name)) for r in BASE]
    every = [(r.name, F.col(r.name)) for r in RULES]
    return found.select("doc_id", *[F.size(r.name).cast("long").alias(f"n_{r.name}") for r in BASE],
                        F.sha2(digest(base), 256).alias("base_sha256"), digest(every).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of every document row, its secrets replaced by ``[RULE]``."""
    keyed = docs.select("doc_id", "text", text_key(F.col("doc_id"), F.col("text")).alias("key"))
    hits = scan(docs).drop("doc_id").dropDuplicates(["key"])
    marks = [(f"[{r.name.upper()}]", F.col(r.name)) for r in RULES]
    return keyed.join(hits, "key").select("doc_id", F.when(F.col("text").isNotNull(), redacted(F.col("text"), marks)).alias("text"))
