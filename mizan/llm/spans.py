"""Places of regular-expression matches, with built-in functions only.

Spark tells what matches but not where. The gaps that split leaves and the matches that regexp_extract_all gives take
turns, so running lengths of both are the places, in code points. They run over chunks of matches first, then within each,
so that a text of very many matches costs no square of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,m:string>"
#: Matches of a chunk.
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(lengths: Column, first: Column) -> Column:
    """array<int>: first, and first plus each running sum of the lengths but the whole."""
    start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """array<struct<s, e, m>>: leftmost non-overlapping matches, s from 0, e exclusive. Empty where gate is false.

    gate must be true wherever the pattern matches; it only saves time.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # (letters before the match and since the one before, match); after the last match nothing counts
    pairs = let(F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found")), lambda x: F.arrays_zip(F.slice(x["gaps"], F.lit(1), F.size(x["found"])).alias("gap"), x["found"].alias("m")))
    length = lambda x: F.length(x["gap"]) + F.length(x["m"])

    def placed(chunk: Column, first: Column) -> Column:
        ends = F.zip_with(running(F.transform(chunk, length), first), chunk, lambda at, x: at + length(x))
        return F.zip_with(ends, chunk, lambda e, x: F.struct((e - F.length(x["m"])).alias("s"), e.alias("e"), x["m"].alias("m")))

    def spans(p: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda k: F.slice(p, k * CHUNK + 1, F.lit(CHUNK)))

        def all_placed(cs: Column) -> Column:
            firsts = running(F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + length(x))), F.lit(0))
            return F.flatten(F.zip_with(cs, firsts, placed))

        return let(chunks, all_placed)

    has = F.regexp_like(text, F.lit(pattern)) if gate is None else gate & F.regexp_like(text, F.lit(pattern))
    return F.when(has, let(pairs, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def labelled(spans: Column, kind: str, rank: int, *more: str) -> Column:
    """array<struct<rank, kind, s, e, ...>> of spans, with more of their fields."""
    return F.transform(spans, lambda x: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), *(x[c].alias(c) for c in ("s", "e", *more))))


def ordered(spans: Column, by_kind: bool) -> Column:
    """Labelled spans by kind then start, or by start then kind."""
    order = ("rank", "s", "e") if by_kind else ("s", "rank", "e")
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct(*(x[c].alias(f"o{i}") for i, c in enumerate(order)), x.alias("span"))))
    return F.transform(ranked, lambda x: x["span"])


def joined(spans: Column | str) -> Column:
    """kind:start:end of labelled spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(spans: Column, by_kind: bool) -> Column:
    """kind:start:end, comma-joined, by kind then start or by start then kind."""
    return joined(ordered(spans, by_kind))
