"""Match positions and redaction as column expressions (code points, end exclusive)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import indices, let, whole

SPAN = "array<struct<start:int,end:int,match:string>>"


def running(xs: Column, combine: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """For each element of an array of int, ``combine`` of all earlier ones (0 before the first).

    Two levels of blocks: the work is n * block at most, not n * n.
    """
    empty = F.array().cast("array<int>")

    def inner(part: Column) -> Column:
        return F.aggregate(
            part, F.struct(F.lit(0).alias("so_far"), empty.alias("out")),
            lambda acc, x: F.struct(combine(acc["so_far"], x).alias("so_far"),
                                    F.concat(acc["out"], F.array(acc["so_far"])).alias("out")))

    def outer(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: p["so_far"])
        return let(inner(totals)["out"], lambda starts: F.flatten(
            F.zip_with(parts, starts, lambda p, s: F.transform(p["out"], lambda x: combine(s, x)))))

    blocks = F.transform(indices(F.ceil(F.size(xs) / block).cast("int")),
                         lambda b: inner(F.slice(xs, b * block + 1, F.lit(block))))
    return let(blocks, outer)


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches the empty string."""
    t = whole(text)

    def placed(found: Column) -> Column:
        pieces = F.slice(F.split(t, pattern, -1), F.lit(1), F.size(found))
        sized = F.zip_with(pieces, found, lambda p, m: F.length(p) + F.length(m))
        return let(let(sized, lambda n: F.zip_with(n, running(n, lambda a, b: a + b), lambda x, s: x + s)),
                   lambda ends: F.zip_with(ends, found, lambda e, m: F.struct(
                       (e - F.length(m)).alias("start"), e.alias("end"), m.alias("match"))))

    return let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found:
               F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(SPAN)))


def digest(kinds: list[tuple[str, Column]]) -> Column:
    """``kind:start:end`` of all spans, comma-joined, by start and then by the order of ``kinds``."""
    def tag(rank: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    tagged = F.concat(*[tag(rank, kind, spans) for rank, (kind, spans) in enumerate(kinds)])
    return F.array_join(F.transform(F.sort_array(tagged), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, kinds: list[tuple[str, Column]]) -> Column:
    """The text with every covered stretch replaced by the mark of the span that starts it."""
    t = whole(text)

    def tag(mark: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mark).alias("mark")))

    tagged = F.sort_array(F.concat(*[tag(mark, spans) for mark, spans in kinds]))

    def cut(all_spans: Column) -> Column:
        reach = running(F.transform(all_spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

        def merged(before: Column) -> Column:
            # A stretch begins where a span starts beyond all earlier ends.
            firsts = F.filter(indices(F.size(all_spans)), lambda i: F.get(all_spans, i)["start"] >= F.get(before, i))
            stop = F.array_max(F.transform(all_spans, lambda s: s["end"]))

            def joined(f: Column) -> Column:
                parts = F.transform(f, lambda i, k: F.concat(
                    F.substring(t, F.coalesce(F.get(before, F.when(k > 0, i)), F.lit(0)) + 1,
                                F.get(all_spans, i)["start"] - F.coalesce(F.get(before, F.when(k > 0, i)), F.lit(0))),
                    F.get(all_spans, i)["mark"]))
                return F.concat(F.array_join(parts, ""), F.substring(t, stop + 1, F.length(t)))

            return let(firsts, joined)

        return let(reach, merged)

    return let(tagged, lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(t))
