"""Small column helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space (space, tab, line feed, vertical tab, form feed, carriage return).
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a computed column that later filters and projections do not recompute.

    The one-element ``explode`` keeps the optimiser from copying a costly
    expression into every place that refers to it.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space, in order."""
    return F.filter(F.split(whole(text), SPACES, -1), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def indices(n: Column) -> Column:
    """``[0, 1, .., n - 1]``; empty for ``n <= 0``."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def shingles(ws: Column, k: int) -> Column:
    """Runs of ``k`` words joined by one space, repeats included.

    Fewer than ``k`` words give one shingle of the whole sequence, no word none.
    """
    n = F.size(ws)
    count = F.when(n >= k, n - (k - 1)).otherwise(F.when(n > 0, F.lit(1)).otherwise(F.lit(0)))
    return F.transform(indices(count), lambda i: F.concat_ws(" ", *[F.get(ws, i + j) for j in range(k)]))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def text_key(doc_id: Column, text: Column) -> Column:
    """Identity of a document row: its id and its text.

    Null ids are allowed; equal rows share a key and so share every verdict.
    """
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")),
                       F.xxhash64(whole(text)).cast("string"), F.length(whole(text)).cast("string"))
