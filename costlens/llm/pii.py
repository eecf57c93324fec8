"""Personal data and the terms that give it away.

Base: e-mail addresses, IP addresses, payment cards and phone numbers by
expression and check.  Beyond them, corpus co-occurrence tells which terms
disclose a protected entity (Sanchez and Batet, "C-sanitized", 2016):

* a protected entity is one found value (kind and text), a term a word of
  three or more letters or digits, lower-cased;
* with ``df(x)`` the texts that hold ``x`` among all ``N`` of the corpus, an
  entity's information is ``IC(e) = log2(N / df(e))`` and a term reveals
  ``PMI(e, t) = log2(N * df(e, t) / (df(e) * df(t)))`` of it;
* what a term leaves hidden is ``IC(e) - PMI(e, t) = -log2(df(e, t) / df(t))``
  bits, in which ``N`` no longer stands: texts that hold neither change no
  verdict.  The share ``df(e, t) / df(t)`` is taken at the lower end of its
  Wilson interval (``Z``, 95 %), at every count, so a word seen once or twice
  proves nothing and a certain sign needs some texts to show it;
* in the texts that hold the entity, terms that leave ``GENERALISE`` bits or
  fewer are generalised (replaced by a class mark), and those that leave
  ``REMOVE`` bits or fewer removed.

A word found only beside an entity is generalised from 4 texts on and removed
from 15 on.  Texts are counted once each, so copies of one text reveal nothing
more about its words.  An entity that every text holds has no information to
reveal.  Documents that hold no protected entity are left as they are.

Defined cases: null and empty texts have no spans and stay null or empty;
texts of any length are read whole; columns other than those named are only
carried, so their names cannot clash; matches are leftmost and do not overlap
within a kind, and one that fails its check is dropped without a second try; equal rows get equal results, each its
own row; null ids keep their rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .spans import SPAN, digest, find, redacted
from .text import let, once, text_key, whole

#: Bits of an entity that a term leaves hidden at most.
GENERALISE, REMOVE = 1.0, 1 / 3
#: Normal quantile of the interval.
Z = 1.96
KINDS = ("email", "ip", "card", "phone")

# The four expressions.  Possessive repeats and the look-behinds
# change no match (a class never overlaps what follows it); they keep long
# runs linear and off the stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
TERM = r"[\p{L}\p{N}]{3,}+"
#: What a term's class mark looks like, and what replaces base spans.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
GENERAL = "[TERM]"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, 9 taken off above 9; the sum ends in 0."""
    numbers = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c: c.cast("int"))
    shown = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(shown, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(OCTETS)
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Struct of the spans of each kind."""
    def of(kind: str) -> Column:
        return F.filter(find(text, PATTERNS[kind]), lambda s: _valid(kind, s["match"]))

    return F.struct(*[of(kind).alias(kind) for kind in KINDS])


def _entities() -> Column:
    """Protected entities of a row with base spans, as ``kind:value``."""
    def named(kind: str) -> Column:
        return F.transform(F.col("base")[kind], lambda s: F.concat(F.lit(f"{kind}:"), s["match"]))

    return F.array_distinct(F.concat(*[named(kind) for kind in KINDS]))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(whole(text)), F.lit(TERM), F.lit(0)))


def _least_share(joint: Column, df_term: Column) -> Column:
    """Lower bound of the Wilson interval of ``joint / df_term``."""
    n, z2 = df_term.cast("double"), Z * Z
    p = joint / n
    return (p + z2 / (2 * n) - Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)


def _hidden(joint: Column, df_term: Column) -> Column:
    """Bits of the entity that the term leaves hidden; grows with ``df_term``."""
    return -F.log2(_least_share(joint, df_term))


def disclosing_terms(docs: DataFrame, found: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``(entity, term, removed)`` of the terms that disclose an entity.

    ``docs`` has ``key`` and ``text`` of every document row; ``found`` a row for
    each with ``key``, ``base``, ``text_hash`` and, where there is personal
    data, ``terms``.
    """
    single = written(found.groupBy("text_hash").agg(F.min("key").alias("key")), "pii-texts")
    total = single.count()
    private = written(found.where("terms is not null").select("text_hash", _entities().alias("entities"), "terms")
                      .dropDuplicates(["text_hash"]), "pii-private")
    held = private.select(F.explode("entities").alias("entity"), "terms")
    known = held.groupBy("entity").agg(F.count("*").alias("df_entity")).where(F.col("df_entity") < total)
    known = written(known.select("entity"), "pii-entities")
    pairs = (held.join(known, "entity").select("entity", F.explode("terms").alias("term"))
             .groupBy("entity", "term").agg(F.count("*").alias("joint")))
    # A term is at least as frequent as it is beside personal data; what falls
    # short even so, common words above all, need not be counted in the corpus.
    least = private.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("least"))
    pairs = pairs.where(_hidden(F.col("joint"), F.col("joint")) <= generalise)
    pairs = pairs.join(least, "term").where(_hidden(F.col("joint"), F.col("least")) <= generalise).drop("least")
    pairs = written(pairs, "pii-pairs")
    # One row of each text, then counts that combine in the tasks before they meet the pairs.
    texts = docs.join(single.select("key").hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    seen = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df_term"))
    hidden = _hidden(F.col("joint"), F.col("df_term"))
    return (pairs.join(seen, "term").where(hidden <= generalise)
            .select("entity", "term", (hidden <= remove).alias("removed")))


def scan(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``(doc_id, key, base, general, removed)``: the spans of every document row."""
    keyed = docs.select("doc_id", "text", text_key(F.col("doc_id"), F.col("text")).alias("key"))
    some = F.exists(F.array(*[F.size(F.col("base")[kind]) for kind in KINDS]), lambda n: n > 0)
    found = written(once(keyed, "base", base_spans(F.col("text"))).select(
        "doc_id", "key", F.xxhash64(whole(F.col("text"))).alias("text_hash"), "base",
        F.when(some, _terms(F.col("text"))).alias("terms")), "pii-base")
    telling = written(disclosing_terms(keyed.select("key", "text"), found, generalise, remove), "pii-disclosing")
    told = (found.select("key", F.explode(_entities()).alias("entity")).join(telling, "entity")
            .groupBy("key", "term").agg(F.max("removed").alias("removed"))
            .groupBy("key").agg(F.collect_list(F.struct("term", "removed")).alias("told")))
    told = written(told, "pii-told")

    def outside(spans: Column) -> Column:
        every = F.concat(*[F.transform(F.col("base")[k], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
                           for k in KINDS])
        return F.filter(spans, lambda s: ~F.exists(every, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))

    def of(spans: Column, removed: bool) -> Column:
        terms = F.transform(F.filter("told", lambda t: t["removed"] == removed), lambda t: t["term"])
        return let(terms, lambda ts: F.filter(spans, lambda s: F.array_contains(ts, F.lower(s["match"]))))

    marked = keyed.join(told, "key").dropDuplicates(["key"]).join(found.select("key", "base").dropDuplicates(["key"]), "key")
    marked = once(marked, "terms", find(F.col("text"), TERM)).select(
        "key", outside(of(F.col("terms"), False)).alias("general"), outside(of(F.col("terms"), True)).alias("removed"))
    empty = F.array().cast(SPAN)
    return found.join(marked, "key", "left").select(
        "doc_id", "key", "base", F.coalesce("general", empty).alias("general"), F.coalesce("removed", empty).alias("removed"))


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digests of the personal data of every document row."""
    base = [(kind, F.col("base")[kind]) for kind in KINDS]
    return scan(docs).select(
        "doc_id", *[F.size(spans).cast("long").alias(f"n_{kind}") for kind, spans in base],
        F.sha2(digest(base), 256).alias("base_sha256"),
        digest([*base, ("general_term", F.col("general")), ("removed_term", F.col("removed"))]).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by its kind, disclosing terms generalised or removed.

    ``n_chars``, where there is such a column, counts the new text.
    """
    spans = scan(docs).drop("doc_id").dropDuplicates(["key"])
    dirty = F.size("general") + F.size("removed")
    for kind in KINDS:
        dirty = dirty + F.size(F.col("base")[kind])
    spans = written(spans.where(dirty > 0), "pii-spans")
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                       text_key(F.col("doc_id"), F.col("text")).alias("key")).join(spans.hint("merge"), "key", "left")
    marks = [*[(MARKS[kind], F.col("base")[kind]) for kind in KINDS],
             (GENERAL, F.col("general")), ("", F.col("removed"))]
    text = F.col("row")["text"]
    rows = once(rows, "clean", F.when(F.col("base").isNull(), text).otherwise(redacted(text, marks)))
    out = []
    for c in names:
        value = F.col("row")[c]
        if c == "text":
            value = F.col("clean")
        elif c == "n_chars":
            value = F.when(F.col("base").isNull(), value).otherwise(F.length("clean").cast(docs.schema[c].dataType))
        out.append(value.alias(c))
    return rows.select(*out)
